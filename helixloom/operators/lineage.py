"""Lines of descent: from a classifier's call to the path through the tree, the alternatives, and how far the call can be trusted.

Paths from the root to every node come from doubling: each node knows a stretch of ancestors and the node above it, and a
join of the table with itself makes stretches twice as long, so a tree of depth d takes log2(d) joins. People meet the
paths in one join.

Defined results: a call of a node that the tree does not have has no path and keeps its name; a node whose ancestors run in a
circle, or name a parent that is missing, has no path; a person without calls has no row; calls of equal rank are ordered by
name; repeated rows of the tree count once; empty fields and placeholders in brackets are no mutations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import forget, stored

#: Qualities from which a call is High or Medium, by line.
LEVELS = {"maternal": (0.90, 0.80), "paternal": (0.95, 0.90)}
DEEPEST = 4096


def call_level(quality: Column, line: str) -> Column:
    high, medium = LEVELS[line]
    return F.when(quality.isNull(), "Not callable").when(quality >= high, "High").when(quality >= medium, "Medium").otherwise("Low")


def mutations(text: Column) -> Column:
    """Words of a list of mutations; remarks in brackets, and the words that stand for nothing, are left out."""
    words = F.split(F.coalesce(text, F.lit("")), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~w.startswith("(") & ~F.lower(w).isin("nan", "none", "null", "-"))


def paths(tree: DataFrame) -> DataFrame:
    """(node, path array): the nodes from the root to each node of a tree (node, parent; a root's parent is null)."""
    up = tree.filter("node IS NOT NULL").groupBy("node").agg(F.min("parent").alias("up"))
    now = stored(up.select("node", F.array("node").alias("path"), "up"), "paths")
    length = 1
    while length < DEEPEST and now.filter("up IS NOT NULL").limit(1).count():
        above = now.select(F.col("node").alias("up"), F.col("path").alias("a_path"), F.col("up").alias("a_up"))
        open_ = now.filter("up IS NOT NULL").join(above, "up")  # a missing parent leaves nothing
        longer = stored(now.filter("up IS NULL").unionByName(open_.select("node", F.concat("a_path", "path").alias("path"), F.col("a_up").alias("up"))), "paths")
        last, now = now, longer
        forget(last)
        length *= 2
    return now.filter("up IS NULL").select("node", "path")


def maternal(hits: DataFrame) -> DataFrame:
    """(person, haplogroup, quality, call_level, found, missing, extra, alternatives) from ranked hits (person, rank, haplogroup, quality,
    found, missing, remaining): the best one, and the others in order."""
    order = Window.partitionBy("person").orderBy(F.asc_nulls_last("rank"), "haplogroup")
    ranked = hits.withColumn("_k", F.row_number().over(order))
    best = ranked.filter("_k = 1")
    others = ranked.filter("_k > 1").groupBy("person").agg(F.array_sort(F.collect_list(F.struct("_k", "haplogroup", "quality"))).alias("o"))  # a few hits for each person
    alternatives = F.transform(F.coalesce("o", F.array().cast("array<struct<_k:int,haplogroup:string,quality:double>>")), lambda x: F.struct(x["haplogroup"].alias("haplogroup"), x["quality"].alias("quality")))
    extra = F.filter(F.split(F.coalesce("remaining", F.lit("")), r"\) "), lambda w: F.trim(w) != "")
    return best.join(others, "person", "left").select("person", "haplogroup", "quality", call_level(F.col("quality"), "maternal").alias("call_level"), mutations(F.col("found")).alias("found"), mutations(F.col("missing")).alias("missing"), extra.alias("extra"), alternatives.alias("alternatives"))


def paternal(calls: DataFrame, tree: DataFrame, states: DataFrame) -> DataFrame:
    """(person, call, haplogroup, quality, call_level, path) from calls (person, call, quality, reads: whether the reads were looked at) and the
    states (person, node, state: D derived, A ancestral) of the person's nodes: the path to the called node with what was seen on
    the way, and the last derived node on it, which is the haplogroup (else the call without its mark). Calls from variant files
    alone are Medium at best."""
    named = calls.withColumn("node", F.split_part("call", F.lit("*"), F.lit(1)))
    steps = named.join(paths(tree), "node", "left").select("person", "call", "quality", "reads", "node", F.posexplode_outer("path").alias("i", "on"))
    seen = states.groupBy("person", F.col("node").alias("on")).agg(F.max("state").alias("state"))
    met = steps.join(seen, ["person", "on"], "left")
    row = F.struct("i", F.col("on").alias("haplogroup"), "state")
    held = met.groupBy("person", "call", "quality", "reads", "node").agg(F.array_sort(F.collect_list(F.when(F.col("on").isNotNull(), row))).alias("p"))  # as long as the tree is deep
    path = F.transform("p", lambda x: F.struct(x["haplogroup"].alias("haplogroup"), x["state"].alias("state")))
    derived = F.filter("p", lambda x: F.coalesce(x["state"] == "D", F.lit(False)))
    level = call_level(F.col("quality"), "paternal")
    capped = F.when(~F.col("reads") & (level == "High"), "Medium").otherwise(level)
    return held.select("person", "call", F.coalesce(F.try_element_at(derived, F.lit(-1))["haplogroup"], "node").alias("haplogroup"), "quality", capped.alias("call_level"), path.alias("path"))
