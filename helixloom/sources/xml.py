"""Knowledge in XML: rare diseases, and plain-language texts about genes and conditions.

Spark's reader splits files into the elements of one tag and reads them against a stated schema, so files of any size are
read in parallel; what is nested becomes rows and arrays by column functions. Every function takes elements as rows: of
files (`elements`) or of a column of texts (`parsed`).

Defined results: elements without a code or a name are left out; lists without items are empty; repeated elements of a disease
are put together, the first text in order of the alphabet standing for each single value; nothing fails on a missing part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clinical import inheritance_code

NAMED = "STRUCT<Name: STRING>"
#: Parts of the elements that are read.
AGES = f"OrphaCode STRING, Name STRING, AverageAgeOfOnsetList STRUCT<AverageAgeOfOnset: ARRAY<{NAMED}>>, TypeOfInheritanceList STRUCT<TypeOfInheritance: ARRAY<{NAMED}>>"
PREVALENCE = f"OrphaCode STRING, Name STRING, PrevalenceList STRUCT<Prevalence: ARRAY<STRUCT<PrevalenceType: {NAMED}, PrevalenceClass: {NAMED}, PrevalenceGeographic: {NAMED}>>>"
GENES = f"OrphaCode STRING, DisorderGeneAssociationList STRUCT<DisorderGeneAssociation: ARRAY<STRUCT<Gene: STRUCT<Symbol: STRING>, DisorderGeneAssociationType: {NAMED}, DisorderGeneAssociationStatus: {NAMED}>>>"
#: The html of a text is read as it stands.
TEXTS = "`text-list` STRUCT<text: ARRAY<STRUCT<`text-role`: STRING, html: STRING>>>"
GENE_SUMMARY = f"`gene-symbol` STRING, name STRING, `ghr-page` STRING, reviewed STRING, {TEXTS}, `db-key-list` STRUCT<`db-key`: ARRAY<STRUCT<db: STRING, key: STRING>>>, `related-health-condition-list` STRUCT<`related-health-condition`: ARRAY<STRUCT<name: STRING>>>"
CONDITION_SUMMARY = f"name STRING, `ghr-page` STRING, reviewed STRING, {TEXTS}"


def elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)


def parsed(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Elements of a column of texts, one in each."""
    return df.select(F.from_xml(F.col(text), schema).alias("x")).select("x.*")



def _names(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: x["Name"]), lambda n: n.isNotNull())


def ages(rows: DataFrame) -> DataFrame:
    """(disease_id, name, onset, inheritance, modes): ages of onset, kinds of inheritance, and their codes."""
    x = rows.filter("OrphaCode IS NOT NULL")
    onset, kinds = _names(F.col("AverageAgeOfOnsetList.AverageAgeOfOnset")), _names(F.col("TypeOfInheritanceList.TypeOfInheritance"))
    told = x.select(F.concat(F.lit("ORPHA:"), "OrphaCode").alias("disease_id"), F.col("Name").alias("name"), F.coalesce(onset, F.array().cast("array<string>")).alias("onset"), F.coalesce(kinds, F.array().cast("array<string>")).alias("inheritance"))
    one = told.groupBy("disease_id").agg(F.min(F.struct("name", "onset", "inheritance")).alias("r")).select("disease_id", "r.*")
    return one.withColumn("modes", F.array_sort(F.array_distinct(F.filter(F.transform("inheritance", inheritance_code), lambda m: m.isNotNull()))))


def prevalences(rows: DataFrame) -> DataFrame:
    """(disease_id, name, prevalence): the best statement: one that is known, then a point prevalence, then one of the whole world,
    then the first."""
    x = rows.filter("OrphaCode IS NOT NULL").select(F.concat(F.lit("ORPHA:"), "OrphaCode").alias("disease_id"), F.col("Name").alias("name"), F.posexplode_outer("PrevalenceList.Prevalence").alias("i", "p"))
    cls, kind, place = F.col("p.PrevalenceClass.Name"), F.coalesce("p.PrevalenceType.Name", F.lit("")), F.coalesce("p.PrevalenceGeographic.Name", F.lit(""))
    known = ~F.lower(cls).rlike("^(unknown|not yet)")
    score = F.when(known, 4).otherwise(0) + F.when(kind == "Point prevalence", 2).otherwise(0) + F.when(place == "Worldwide", 1).otherwise(0)
    text = F.when(kind != "", F.concat(cls, F.lit(" ("), F.lower(kind), F.lit(", "), place, F.lit(")"))).otherwise(cls)
    best = F.max_by(F.struct(text.alias("text")), F.when(cls.isNotNull() & (cls != ""), F.struct(score, -F.col("i"))))
    return x.groupBy("disease_id").agg(F.min("name").alias("name"), best.alias("b")).select("disease_id", "name", F.col("b.text").alias("prevalence"))


def gene_links(rows: DataFrame) -> DataFrame:
    """(gene, disease_id, association_type, status), one row for each link."""
    x = rows.filter("OrphaCode IS NOT NULL").select(F.concat(F.lit("ORPHA:"), "OrphaCode").alias("disease_id"), F.explode("DisorderGeneAssociationList.DisorderGeneAssociation").alias("a"))
    return x.select(F.col("a.Gene.Symbol").alias("gene"), "disease_id", F.col("a.DisorderGeneAssociationType.Name").alias("association_type"), F.col("a.DisorderGeneAssociationStatus.Name").alias("status"))


def rare_diseases(by_age: DataFrame, by_prevalence: DataFrame) -> DataFrame:
    """(disease_id, name, modes, inheritance, onset, prevalence) of the diseases of either file."""
    j = ages(by_age).join(prevalences(by_prevalence).withColumnRenamed("name", "p_name"), "disease_id", "full")
    none = F.array().cast("array<string>")
    return j.select("disease_id", F.coalesce("name", "p_name").alias("name"), *[F.coalesce(c, none).alias(c) for c in ("modes", "inheritance", "onset")], "prevalence")


def flat(html: Column) -> Column:
    """Plain text: a paragraph or item a line, white space of any length as one space; without those, all text as one line."""
    tags = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), r"\s+", " "))
    plain = lambda t: F.replace(F.replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    parts = F.regexp_extract_all(html, F.lit(r"(?s)<(?:\w+:)?(?:p|li)(?:\s[^>]*)?>(.*?)</(?:\w+:)?(?:p|li)>"), F.lit(1))
    lines = F.filter(F.transform(parts, tags), lambda t: t != "")
    return F.coalesce(plain(F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(tags(html))), F.lit(""))


def _text(role: str) -> Column:
    found = F.filter(F.col("`text-list`.text"), lambda t: t["text-role"] == role)
    return flat(F.try_element_at(found, F.lit(-1))["html"])


def gene_texts(rows: DataFrame) -> DataFrame:
    """(gene, name, url, function, reviewed, ncbi_id, conditions)."""
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    keys = F.filter(F.col("`db-key-list`.`db-key`"), lambda k: k["db"] == "NCBI Gene")
    conditions = F.filter(F.transform(F.col("`related-health-condition-list`.`related-health-condition`"), lambda c: c["name"]), lambda n: n.isNotNull())
    return rows.filter("`gene-symbol` IS NOT NULL").select(trimmed("`gene-symbol`").alias("gene"), trimmed("name").alias("name"), trimmed("`ghr-page`").alias("url"), _text("function").alias("function"), F.trim("reviewed").alias("reviewed"), F.try_element_at(keys, F.lit(-1))["key"].alias("ncbi_id"), F.coalesce(conditions, F.array().cast("array<string>")).alias("conditions"))


def condition_texts(rows: DataFrame) -> DataFrame:
    """(name, url, description, reviewed)."""
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return rows.filter("name IS NOT NULL").select(trimmed("name").alias("name"), trimmed("`ghr-page`").alias("url"), _text("description").alias("description"), F.trim("reviewed").alias("reviewed"))
