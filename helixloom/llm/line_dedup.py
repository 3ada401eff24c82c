"""Line dedup by a deletion-neighbourhood join, edit bound 1.

A line (split at newlines, of at least `min_chars` code points) is dropped if the same line, or one within one edit of
it (a character put in, left out or replaced), stands earlier: in a row with a smaller key, or further up in the same
row. Of exact repeats the first occurrence stays; a line that is within one edit of an earlier line goes wherever it
stands, also if that earlier line goes itself. Shorter lines take no part in the near step, as one edit in a very short line means little. With `short_repeats`
their exact repeats go as well, if they hold a word: what takes the copies of a document away as a whole. Without it,
shorter lines are left alone.

Every line emits its deletion variants as hashed keys, and equal variants are joined. Three steps keep that linear:
- equal lines are first collapsed to one (by a 128-bit hash and length) with their earliest place;
- two lines within one edit agree on a half, and then on all but one of their stretches of SEGMENT characters, seen from
  the nearer end. Lines that share a half with no other line, and then stretches that share their surroundings with no
  other line, emit no variants; variants are formed within the one stretch that may differ;
- a variant carries the place of its deletion: two lines with the same variant at the same place differ in one
  character there, and a line that is itself a variant of another is one character shorter. So each variant needs only
  its earliest line, found by an aggregation, and pairs within a group are never formed.
The edit distance of each line to its earliest partner is then verified.

Only DataFrame functions are used. Hot lines are pre-aggregated before the shuffle, and the joins of occurrences are
plain inner joins that adaptive execution can split.

Defined results: null and empty texts have no lines to drop; a null key counts as smallest; rows with the same key and
text are alike: the same lines are dropped from each, and their first occurrences stay in each; rows with the same key
and different texts are told apart by a hash of the text; an empty table gives an empty result; very long lines
take time and memory in proportion to their length; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, narrowed, put_back, remove, set_aside, text_of, written

MIN_CHARS = 20
SEGMENT = 64
WORD = r"[^\x20\x09-\x0D]"


def _row(key: str, text: str) -> Column:
    return F.struct(F.col(f"`{key}`").alias("key"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("th"))


def occurrences(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, short_repeats: bool = False) -> DataFrame:
    """(row, line_no, line, n, h1, h2): the lines that take part, with length and hashes."""
    lines = df.select(_row(key, text).alias("row"), F.posexplode(F.split(text_of(F.col(f"`{text}`")), "\n")).alias("line_no", "line"))
    long = F.col("n") >= min_chars
    lines = lines.withColumn("n", F.length("line")).filter(long | F.col("line").rlike(WORD) if short_repeats else long)
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line", F.lit(2))})


def _halves() -> Column:
    """Hashes of the halves of `line`, seen from either end, for pairs whose shorter line has n or n - 1 characters."""
    keys = []
    for less in (0, 1):
        base = F.col("n") - less
        p = F.floor(base / 2).cast("int")
        q = base - p
        keys.append(F.xxhash64(F.lit(0), base, F.substring("line", F.lit(1), p)))
        keys.append(F.xxhash64(F.lit(1), base, F.substring("line", F.col("n") - q + 1, q)))
    return F.array(*keys)


def distinct_lines(occ: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, first, times, halves): one row for each distinct line, first being its earliest (row, line_no); lines under
    `min_chars` have no halves."""
    halves = F.when(F.col("n") >= min_chars, _halves()).otherwise(F.array().cast("array<bigint>"))
    slim = occ.select("h1", "h2", F.struct("row", "line_no").alias("at"), halves.alias("halves"))
    return slim.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("times"), F.first("halves").alias("halves"))


def _segments(texts: DataFrame) -> DataFrame:
    """(no, k, mid): for each line, seen as one of `base` characters or one more, all of it but one stretch (k, a hash) and
    that stretch (mid). Stretches are SEGMENT characters, or the halves of a short line, and are cut once from the left
    and once from one character on, so that the work follows the line's length."""
    cut = lambda line, base: F.when(base >= 2 * SEGMENT, F.regexp_extract_all(line, F.lit("(?s).{1,%d}" % SEGMENT), F.lit(0))).otherwise(F.array(F.substring(line, F.lit(1), F.floor(base / 2).cast("int")), F.substring(line, F.floor(base / 2).cast("int") + 1, base)))
    bases = texts.select("no", "line", F.col("n").alias("d0"), F.explode(F.array(F.col("n"), F.col("n") - 1)).alias("base"))
    left = cut(F.col("line"), F.col("base"))
    right = cut(F.expr("substring(line, 1 + d0 - base)"), F.col("base"))
    s_n = F.when(F.col("base") >= 2 * SEGMENT, F.ceil(F.col("base") / SEGMENT)).otherwise(2).cast("int")
    parts = bases.select("no", "base", (F.col("d0") - F.col("base")).alias("d"), F.slice(F.arrays_zip(left.alias("l"), right.alias("r")), F.lit(1), s_n).alias("parts"))
    rows = parts.select("no", "base", "d", F.posexplode("parts").alias("s", "p")).select("no", "base", "d", "s", F.col("p.l").alias("l"), F.col("p.r").alias("r"))
    rows = rows.withColumns({"lh": F.xxhash64("s", "l"), "rh": F.xxhash64("s", "r")})
    whole = Window.partitionBy("no", "base")
    upto = whole.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"before": F.bit_xor("lh").over(upto), "r_upto": F.bit_xor("rh").over(upto), "r_all": F.bit_xor("rh").over(whole)})
    k = F.xxhash64("base", "s", F.col("before").bitwiseXOR(F.col("lh")), F.col("r_all").bitwiseXOR(F.col("r_upto")))
    mid = F.when(F.col("d") == 1, F.concat(F.substring("l", 1, 1), "r")).otherwise(F.col("l"))
    return rows.select("no", k.alias("k"), mid.alias("mid"))


def _one_edit(x: Column, y: Column) -> Column:
    """Whether two lines are one edit apart or equal. Of long lines, only the first stretch that differs is measured; what follows
    it must be the same."""
    pieces = lambda t: F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % SEGMENT), F.lit(0))
    same = F.zip_with(pieces(x), pieces(y), lambda a, b: F.coalesce(a == b, F.lit(False)))

    def at(i: Column) -> Column:
        a, b = i * SEGMENT + 1, (i + 1) * SEGMENT + 1
        more = lambda u, v: F.greatest(F.length(u) - F.length(v), F.lit(0))
        part = lambda u, v: F.substring(u, a, SEGMENT + more(u, v))
        rest = lambda u, v: F.substring(u, b + more(u, v), F.length(u))
        return (F.levenshtein(part(x, y), part(y, x), 1) >= 0) & (rest(x, y) == rest(y, x))

    apart = F.abs(F.length(x) - F.length(y)) <= 1
    long = let(F.array_position(same, False).cast("int") - 1, lambda i: (i < 0) | at(i))
    return apart & F.when(F.greatest(F.length(x), F.length(y)) > 16 * SEGMENT, long).otherwise(F.levenshtein(x, y, 1) >= 0)


def near_lines(occ: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, h2, partner): distinct lines within one edit of an earlier one, and the place of the earliest such line. `lines`
    is written, as distinct_lines gives it."""
    keys = lines.select("h1", "h2", F.explode("halves").alias("k"))
    shared = written(keys.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"), "shared")
    some = written(narrowed(keys, shared, ["k"]).select("h1", "h2").distinct(), "some")
    firsts = narrowed(lines.select("h1", "h2", "first"), some, ["h1", "h2"])
    places = narrowed(occ.select("h1", "h2", F.struct("row", "line_no").alias("first"), "line", "n"), some, ["h1", "h2"])
    texts = places.join(firsts, ["h1", "h2", "first"]).dropDuplicates(["h1", "h2"])
    # From here on a line goes by its number; the smaller one is the earlier line.
    texts = written(texts.orderBy("first", "h1", "h2").withColumn("no", F.monotonically_increasing_id()), "lines")
    remove(shared, some)

    segs = _segments(texts)
    both = written(segs.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"), "both")
    segs = narrowed(segs, both, ["k"])

    # Deletion variants: place 0 is the stretch itself.
    drop = lambda i: F.struct(i.alias("i"), F.xxhash64(F.concat(F.substring("mid", F.lit(1), i - 1), F.substring("mid", i + 1, F.length("mid")))).alias("v"))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.xxhash64("mid").alias("v")))
    variants = F.concat(whole, F.when(F.length("mid") > 0, F.transform(F.sequence(F.lit(1), F.length("mid")), drop)).otherwise(F.filter(whole, lambda x: F.lit(False))))
    rows = written(segs.select("k", "no", F.inline(variants)), "variants")
    same = rows.filter("i > 0").groupBy("k", "v", "i").agg(F.min("no").alias("best"))
    replaced = rows.filter("i > 0").join(same, ["k", "v", "i"]).filter("best < no").select("no", "best")
    ends = rows.groupBy("k", "v").agg(F.min(F.when(F.col("i") == 0, F.col("no"))).alias("whole"), F.min(F.when(F.col("i") > 0, F.col("no"))).alias("cut"))
    longer = rows.join(ends, ["k", "v"]).withColumn("best", F.when(F.col("i") == 0, F.col("cut")).otherwise(F.col("whole"))).filter("best < no").select("no", "best")
    best = written(replaced.unionByName(longer).groupBy("no").agg(F.min("best").alias("best")), "best")
    remove(both, rows)

    mine = texts.select("no", "h1", "h2", F.col("line").alias("x"))
    other = texts.select(F.col("no").alias("best"), F.col("first").alias("partner"), F.col("line").alias("y"))
    checked = best.join(mine, "no").join(other, "best").filter(_one_edit(F.col("x"), F.col("y")))
    near = written(checked.select("h1", "h2", "partner"), "near")
    remove(texts, best)
    return near


def dropped(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, short_repeats: bool = False) -> DataFrame:
    """(row, line_no, kind, kept): every occurrence to drop; kind is exact or near, kept the place it repeats."""
    occ = occurrences(df, key, text, min_chars, short_repeats)
    lines = written(distinct_lines(occ, min_chars), "distinct")
    near = near_lines(occ, lines)
    told = lines.select("h1", "h2", "first", "times").join(near, ["h1", "h2"], "left").filter("times > 1 OR partner IS NOT NULL")
    told = written(told, "told")
    remove(lines, near)
    at = F.struct("row", "line_no")
    found = occ.select("h1", "h2", "row", "line_no").join(told, ["h1", "h2"]).filter(F.col("partner").isNotNull() | (at != F.col("first")))
    return found.select("row", "line_no", F.when(F.col("partner").isNotNull(), "near").otherwise("exact").alias("kind"), F.coalesce("partner", "first").alias("kept"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, short_repeats: bool = False) -> DataFrame:
    """df without the dropped lines. A row that had words and has none left goes; all others stay."""
    df, named = set_aside(df, "_d_")
    key, text = named[key], named[text]
    gone = dropped(df, key, text, min_chars, short_repeats).distinct().groupBy(F.col("row").alias("_d_row")).agg(F.collect_list("line_no").alias("_d_gone"))
    rows = df.withColumn("_d_row", _row(key, text)).join(gone, "_d_row", "left")
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_d_gone"))
    joined = let(F.split(text_of(F.col(f"`{text}`")), "\n"), lambda x: F.array_join(F.transform(left(x), lambda i: F.get(x, i)), "\n"))
    rows = rows.withColumn("_d_text", F.when(F.col("_d_gone").isNull(), F.col(f"`{text}`")).otherwise(joined))
    rows = rows.filter(F.col("_d_gone").isNull() | F.col("_d_text").rlike(WORD))
    return put_back(rows.select(*[F.col("_d_text").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]), named)
