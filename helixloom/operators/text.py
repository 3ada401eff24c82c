"""Checks of texts against tables: citations, authors, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITED = r"\[\[([a-z_]+:[^\]\s]+)\]\]"
HOME = "^https?://[^/?#]+/?$"


def citation_check(blocks: DataFrame, before: DataFrame, now: DataFrame, citable: tuple[str, ...]) -> DataFrame:
    """(doc_id, ref, status) of each [[table:key]] in the blocks (doc_id, block): ok, stale (the row's fingerprint changed since the
    text was written), missing, unknown table; a block without a citation is uncited. Tables are (ref, fingerprint)."""
    refs = blocks.select("doc_id", F.explode_outer(F.array_distinct(F.regexp_extract_all("block", F.lit(CITED), F.lit(1)))).alias("ref"))
    j = refs.join(before.select("ref", F.col("fingerprint").alias("was")), "ref", "left").join(now.select("ref", F.col("fingerprint").alias("is"), F.lit(True).alias("there")), "ref", "left")
    known = F.split_part("ref", F.lit(":"), F.lit(1)).isin(*citable)
    status = F.when(F.col("ref").isNull(), "uncited").when(~known, "unknown table").when(F.col("there").isNull(), "missing").when(~F.col("is").eqNullSafe(F.col("was")), "stale").otherwise("ok")
    return j.select("doc_id", "ref", status.alias("status"))


def first_author_match(citation: Column, surname: Column) -> Column:
    """Whether a citation begins with the surname as a whole word, in any case."""
    c, s = F.lower(F.trim(citation)), F.lower(F.trim(surname))
    after = F.substring(c, F.length(s) + 1, F.lit(1))
    return F.coalesce(F.startswith(c, s) & ~after.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def sample_links(df: DataFrame, url: str, n: int, seed: int) -> DataFrame:
    """(url, fixed): all distinct home pages, and n of the other distinct links by a seeded hash (the sample is the feature)."""
    u = df.filter(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct().withColumn("fixed", F.col("url").rlike(HOME))
    some = u.filter("NOT fixed").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "url"))).limit(n)
    return u.filter("fixed").unionByName(some)
