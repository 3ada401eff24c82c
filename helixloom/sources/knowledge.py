"""Knowledge files as tables. Every reader takes lines (a DataFrame with a text column `value`, as spark.read.text gives it), so
that files of any number and size are read in parallel; nothing is collected. '.', '-' and empty fields are null where the
format says so, numbers that do not parse are null, and nothing fails on a short line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import canon_chrom, chrom_order
from ..functions.evidence import sig_class
from ..functions.text import strip_markup

#: Stars of a review status; codes of the ontology's modes of inheritance; rank of a summary's source.
STARS = {"practice_guideline": 4, "reviewed_by_expert_panel": 3, "criteria_provided,_multiple_submitters,_no_conflicts": 2, "criteria_provided,_conflicting_classifications": 1, "criteria_provided,_single_submitter": 1}
MODES = {"HP:0000006": "AD", "HP:0000007": "AR", "HP:0001417": "XL", "HP:0001419": "XLR", "HP:0001423": "XLD", "HP:0001427": "MT", "HP:0001450": "YL"}
SUMMARY_RANK = {"RefSeq": 0, "OMIM": 1}
SV_TYPES = ("DEL", "DUP", "CNV", "MCNV")
#: Genome-wide significance, as -log10 p.
SIGNIFICANT = 7.30103


def fields(lines: DataFrame, names: list[str], sep: str = "\t") -> DataFrame:
    """Lines as columns of text; comment lines and empty ones are left out, missing fields are null."""
    parts = F.split("value", sep)
    kept = lines.filter((F.length("value") > 0) & ~F.col("value").startswith("#"))
    return kept.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def told(c: str, nothing: tuple[str, ...] = (".", "")) -> Column:
    return F.when(~F.col(c).isin(*nothing), F.col(c))


def _looked_up(key: Column, table: dict, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def clinical_variants(lines: DataFrame) -> DataFrame:
    """Classified alleles: chrom pos id ref alt significance review conditions genes consequences condition_ids, without rows that
    name no alternative."""
    x = fields(lines, ["chrom", "pos", "id", "ref", "alt", "sig", "review", "names", "genes", "mc", "ids"]).filter("alt <> '.'")
    head = F.lower(F.split_part(told("sig"), F.lit("|"), F.lit(1)))
    genes = F.transform(F.split(told("genes"), r"\|"), lambda g: F.split_part(g, F.lit(":"), F.lit(1)))
    effects = F.array_distinct(F.transform(F.split(told("mc"), ","), lambda m: F.split_part(m, F.lit("|"), F.lit(2))))
    return x.select(
        canon_chrom(F.col("chrom")).alias("chrom"), chrom_order(F.col("chrom")).alias("chrom_order"), F.col("pos").try_cast("int").alias("pos"), "ref", "alt", F.col("id").try_cast("bigint").alias("variation_id"),
        told("sig").alias("significance"), sig_class(head).alias("cls"), F.coalesce(F.contains(F.lower("sig"), F.lit("low_penetrance")), F.lit(False)).alias("low_penetrance"),
        _looked_up(F.col("review"), STARS, 0).alias("stars"), genes.alias("genes"), effects.alias("consequences"), F.replace(told("names"), F.lit("_"), F.lit(" ")).alias("conditions"), told("ids").alias("condition_ids"),
    )


def submissions(lines: DataFrame) -> DataFrame:
    """One lab's classification a row: variation_id significance date conditions (C1:Name;C2:Name) contributes."""
    x = fields(lines, ["id", "sig", "date", "reported", "contributes"])
    names = F.filter(F.transform(F.split("reported", ";"), lambda c: F.trim(F.regexp_replace(c, "^[^:]*:", ""))), lambda c: c != "")
    day = F.try_to_timestamp(told("date", ("-", "")), F.lit("MMM dd, yyyy")).cast("date")
    return x.select(F.col("id").try_cast("bigint").alias("variation_id"), F.col("sig").alias("significance"), sig_class(F.lower(F.replace("sig", F.lit(" "), F.lit("_")))).alias("cls"), day.alias("evaluated"), names.alias("conditions"), (F.col("contributes") == "yes").alias("contributes"))


def allele_frequencies(lines: DataFrame) -> DataFrame:
    """One row for each alternative letter: chrom pos ref alts afs (comma-joined alike); symbolic alternatives go."""
    x = fields(lines, ["chrom", "pos", "ref", "alts", "afs"])
    rows = x.select("chrom", "pos", "ref", F.explode(F.arrays_zip(F.split("alts", ",").alias("alt"), F.split("afs", ",").alias("af"))).alias("a"))
    return rows.select(canon_chrom(F.col("chrom")).alias("chrom"), F.col("pos").try_cast("int").alias("pos"), "ref", F.col("a.alt").alias("alt"), F.col("a.af").try_cast("double").alias("af")).filter("alt NOT LIKE '<%'")


def structural_frequencies(lines: DataFrame) -> DataFrame:
    """Frequencies of deletions, duplications and copy numbers: chrom start end name type af popmax genes."""
    x = fields(lines, ["chrom", "start", "end", "name", "svtype", "af", "popmax", "genes"]).filter(F.col("svtype").isin(*SV_TYPES))
    return x.select(canon_chrom(F.col("chrom")).alias("chrom"), F.col("start").try_cast("bigint").alias("start_pos"), F.col("end").try_cast("bigint").alias("end_pos"), "name", "svtype", F.col("af").try_cast("double").alias("af"), F.col("popmax").try_cast("double").alias("popmax_af"), told("genes", ("NA", "")).alias("genes"))


def missense_scores(lines: DataFrame) -> DataFrame:
    """Largest score of each allele, and the protein change that has it: chrom pos ref alt protein score."""
    x = fields(lines, ["chrom", "pos", "ref", "alt", "protein", "score"]).withColumn("score", F.col("score").try_cast("double")).filter("score IS NOT NULL")
    return x.groupBy(canon_chrom(F.col("chrom")).alias("chrom"), F.col("pos").try_cast("int").alias("pos"), "ref", "alt").agg(F.max("score").alias("score"), F.max_by("protein", F.struct("score", "protein")).alias("protein"))


def gene_constraint(lines: DataFrame) -> DataFrame:
    """One row for each gene: gene transcript mane canonical loeuf pli. Each value is that of the best transcript that has it, the
    standard one before the canonical one; other transcripts do not count."""
    x = fields(lines, ["gene", "transcript", "mane", "canonical", "loeuf", "pli"]).filter("mane = 'true' OR canonical = 'true'")
    order = F.struct((F.col("mane") == "true").cast("int") * 2 + (F.col("canonical") == "true").cast("int"), "transcript")
    best = lambda v: F.max_by(v, F.when(v.isNotNull(), order))
    return x.groupBy("gene").agg(best(F.col("transcript")).alias("transcript"), best(F.col("loeuf").try_cast("double")).alias("loeuf"), best(F.col("pli").try_cast("double")).alias("pli"))


def disease_modes(lines: DataFrame) -> DataFrame:
    """(disease_id, modes): sorted modes of inheritance of each disease: disease_id name term aspect. Diseases without one stay."""
    x = fields(lines, ["disease_id", "name", "term", "aspect"])
    code = F.when(F.col("aspect") == "I", F.try_element_at(F.create_map(*[F.lit(v) for kv in MODES.items() for v in kv]), F.col("term")))
    return x.groupBy("disease_id").agg(F.array_sort(F.collect_set(code)).alias("modes"))


def ontology_terms(stanzas: DataFrame) -> DataFrame:
    """(id, name, definition, xrefs) of an ontology's stanzas, each a text of lines (read with an empty line as separator);
    obsolete terms and other stanzas are left out."""
    v = F.col("value")
    line = lambda k: F.nullif(F.regexp_extract(v, rf"(?m)^{k}: (.*)$", 1), F.lit(""))
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all(v, F.lit(r"(?m)^xref: ((?:OMIM|ORPHA):[0-9]+)"), F.lit(1))))
    kept = stanzas.filter(v.startswith("[Term]") & ~F.contains(v, F.lit("is_obsolete: true")))
    return kept.select(line("id").alias("id"), line("name").alias("name"), F.regexp_extract(v, r'(?m)^def: "([^"]*)"', 1).alias("definition"), refs.alias("xrefs"))


def gene_summaries(genes: DataFrame, summaries: DataFrame) -> DataFrame:
    """(gene, summary, source): genes (gene_id official symbol) with one summary each (gene_id source summary), by the rank of
    its source; the official symbol unless it is '-'."""
    g = fields(genes, ["gene_id", "official", "symbol"])
    s = fields(summaries, ["gene_id", "source", "summary"])
    rank = _looked_up(F.col("source"), SUMMARY_RANK, 2)
    one = s.groupBy("gene_id").agg(F.min_by(F.struct("summary", "source"), F.struct(rank, "source", "summary")).alias("s"))
    return g.join(one, "gene_id", "left").select(F.coalesce(told("official", ("-", "")), F.col("symbol")).alias("gene"), strip_markup(F.col("s.summary")).alias("summary"), F.col("s.source").alias("source"))


def associations(lines: DataFrame) -> DataFrame:
    """Catalogue associations: rsid trait allele mlog10p or_beta study pmid."""
    x = fields(lines, ["rsid", "trait", "snp_allele", "mlog10p", "or_beta", "study", "pmid"])
    return x.select("rsid", "trait", F.split_part("snp_allele", F.lit("-"), F.lit(2)).alias("effect_allele"), F.col("mlog10p").try_cast("double").alias("mlog10p"), F.col("or_beta").try_cast("double").alias("or_beta"), "study", "pmid")


def featured_associations(found: DataFrame, featured: DataFrame) -> DataFrame:
    """For each featured (rsid, trait) the best significant association, known allele first, then the smallest p-value, and how
    many publications and studies have one."""
    sure = found.join(featured.select("rsid", "trait").distinct(), ["rsid", "trait"], "left_semi").filter(F.col("mlog10p") >= SIGNIFICANT)
    order = F.struct(F.col("effect_allele").isin("A", "C", "G", "T"), "mlog10p", "study", "pmid")
    return sure.groupBy("rsid", "trait").agg(F.max_by(F.struct("effect_allele", "or_beta", "study"), order).alias("b"), F.count_distinct("pmid").alias("publications"), F.count_distinct("study").alias("studies")).select("rsid", "trait", "b.effect_allele", "b.or_beta", F.col("b.study").alias("best_study"), "publications", "studies")


def evaluations(metrics: DataFrame, scores: DataFrame, sets: DataFrame) -> DataFrame:
    """Evaluations of scores: ppm pgs set pgp | pgs pgp | set n; independent where another paper than the developing one did it."""
    m, s, e = fields(metrics, ["ppm_id", "pgs_id", "set_id", "pgp_id"]), fields(scores, ["pgs_id", "own_pgp"]), fields(sets, ["set_id", "n"])
    j = m.join(s, "pgs_id").join(e, "set_id", "left")
    return j.select("ppm_id", "pgs_id", (F.col("pgp_id") != F.col("own_pgp")).alias("independent"), F.col("n").try_cast("double").cast("bigint").alias("n"))


def gene_ratings(sheets: dict[str, DataFrame]) -> DataFrame:
    """Ratings of several sheets in one table (context, gene, rating): banner lines of pluses and the header go."""
    out = None
    for context, lines in sheets.items():
        x = fields(lines, ["gene", "rating"], ",").filter(~F.col("gene").rlike(r"^\+") & (F.col("gene") != "GENE")).withColumn("context", F.lit(context))
        out = x if out is None else out.unionByName(x)
    return out


def expect_rows(df: DataFrame, least: int, name: str) -> DataFrame:
    """(name, n_rows, whole): whether a table has as many rows as a whole file has at least."""
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", (F.col("n_rows") >= least).alias("whole"))


def standard_transcripts(lines: DataFrame) -> DataFrame:
    """(gene, transcript, status, refseq) of a list of standard transcripts; version numbers of transcripts go."""
    x = fields(lines, ["gene", "transcript", "status", "refseq"])
    return x.select("gene", F.split_part("transcript", F.lit("."), F.lit(1)).alias("transcript"), "status", told("refseq", ("-", "")).alias("refseq"))


def panel_exons(exons: DataFrame, standard: DataFrame) -> DataFrame:
    """Exons (gene, transcript, start_pos, end_pos) of one transcript for each gene: the standard one, then that with the most
    exons, then the first by name."""
    n = exons.groupBy("gene", "transcript").agg(F.count("*").alias("n"))
    mark = standard.select("gene", "transcript", F.lit(1).alias("std")).distinct()
    order = F.struct((-F.coalesce("std", F.lit(0))).alias("a"), (-F.col("n")).alias("b"), "transcript")
    chosen = n.join(mark, ["gene", "transcript"], "left").groupBy("gene").agg(F.min_by("transcript", order).alias("transcript"))
    return exons.join(chosen, ["gene", "transcript"], "left_semi")


def immune_types(lines: DataFrame) -> DataFrame:
    """(gene, alleles, qualities) of a typing table: gene n allele_1 quality_1 allele_2 quality_2. Names keep two fields; a single
    allele is carried twice."""
    x = fields(lines, ["gene", "n", "a1", "q1", "a2", "q2"]).filter("gene LIKE 'HLA-%'")
    short = lambda a: F.concat(F.lit("*"), F.array_join(F.slice(F.split(F.split_part(a, F.lit("*"), F.lit(2)), ":"), 1, 2), ":"))
    pair = lambda a, q: F.when(told(a).isNotNull(), F.struct(short(F.col(a)).alias("a"), F.floor(F.col(q).try_cast("double")).cast("int").alias("q")))
    found = F.array_compact(F.array(pair("a1", "q1"), pair("a2", "q2")))
    x = x.withColumn("f", F.when((F.col("n") == "1") & (F.size(found) > 0), F.concat(found, found)).otherwise(found))
    return x.select("gene", F.transform("f", lambda s: s["a"]).alias("alleles"), F.transform("f", lambda s: s["q"]).alias("qualities"))


REPORT = "struct<drugs:array<struct<name:string,guidelines:array<struct<source:string,annotations:array<struct<recommendation:string,genotypes:array<struct<gene:string,phenotype:string>>>>>>>>>"


def guideline_report(lines: DataFrame) -> DataFrame:
    """(drug, source, recommendation, genes): one row for each annotation of a nested report, a document a line; guidelines
    without annotations keep a row."""
    drugs = lines.select(F.explode(F.from_json("value", REPORT)["drugs"]).alias("d"))
    by_source = drugs.select(F.col("d.name").alias("drug"), F.explode_outer("d.guidelines").alias("g"))
    rows = by_source.select("drug", F.col("g.source").alias("source"), F.explode_outer("g.annotations").alias("a"))
    return rows.select("drug", "source", F.col("a.recommendation").alias("recommendation"), F.array_sort(F.array_distinct(F.transform("a.genotypes", lambda x: x["gene"]))).alias("genes"))


def call_labels(**labelled: DataFrame) -> DataFrame:
    """Call sets (chrom, pos, ref, alt, gt) by label in one table, with copies of the row's allele."""
    out = None
    for label, df in labelled.items():
        copies = F.size(F.filter(F.split("gt", r"[/|]"), lambda x: x == "1"))
        x = df.select("chrom", "pos", "ref", "alt", copies.alias("copies"), F.lit(label).alias("label"))
        out = x if out is None else out.unionByName(x)
    return out


def actionable_genes(lines: DataFrame) -> DataFrame:
    """(gene, category, rule, conditions): a list of genes with a condition a line, gathered for each gene (a few)."""
    x = fields(lines, ["gene", "category", "condition", "rule"], ",").filter("gene <> 'gene'")
    return x.groupBy("gene").agg(F.min("category").alias("category"), F.min("rule").alias("rule"), F.array_sort(F.collect_set("condition")).alias("conditions"))


def panel_samples(panels: dict[str, DataFrame], groups: dict[str, str], unrelated: DataFrame) -> DataFrame:
    """Samples (sample population region) of several panels with their continental group; related unless listed."""
    out = None
    for panel, lines in panels.items():
        x = fields(lines, ["sample", "population", "region"]).withColumn("panel", F.lit(panel))
        out = x if out is None else out.unionByName(x)
    listed = unrelated.select("sample", F.lit(False).alias("rel")).distinct()
    return out.join(listed, "sample", "left").select("panel", "sample", "population", _looked_up(F.col("region"), groups, "other").alias("grp"), F.coalesce("rel", F.lit(True)).alias("related"))


def difficult_regions(regions: dict[str, DataFrame]) -> DataFrame:
    """Regions (chrom_order, start_pos, end_pos) of several files, merged within each, with their reason."""
    from ..operators.intervals import merge

    out = None
    for reason, df in regions.items():
        x = merge(df, ["chrom_order"], "start_pos", "end_pos").withColumn("reason", F.lit(reason))
        out = x if out is None else out.unionByName(x)
    return out


def defining_positions(lines: DataFrame) -> DataFrame:
    """(gene, chrom, pos, rsid, ref, alts) of a site file: chrom pos id ref alt qual filter info, the gene in PX of the info."""
    x = fields(lines, ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"])
    info = F.str_to_map("info", F.lit(";"), F.lit("="))
    return x.select(F.try_element_at(info, F.lit("PX")).alias("gene"), canon_chrom(F.col("chrom")).alias("chrom"), F.col("pos").try_cast("int").alias("pos"), told("id").alias("rsid"), "ref", F.split("alt", ",").alias("alts"))


def score_weights(files: list[DataFrame]) -> DataFrame:
    """Weight files with differing columns (score_id chrom pos effect_allele and maybe other_allele) in one table: autosomes only."""
    out = None
    for df in files:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.filter(F.col("chrom").try_cast("int").between(1, 22))


def json_records(lines: DataFrame, schema: str) -> DataFrame:
    """A document a line as columns; documents that do not parse are left out."""
    x = lines.select(F.from_json("value", schema).alias("x")).filter("x IS NOT NULL")
    return x.select("x.*")


def catalogue_genes(alleles: DataFrame) -> DataFrame:
    return alleles.select("allele", F.split_part("allele", F.lit("*"), F.lit(1)).alias("gene"))
