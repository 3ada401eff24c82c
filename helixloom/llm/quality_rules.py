"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule. A policy
is a versioned set of rules, applied by a bitwise AND; ablations come from the counts of distinct bit patterns.

Defined results: a null text counts as empty (zero words, fails ``few_words``); repeated rows are judged one by one;
an empty table gives an empty ledger; columns of the input stay, and a column already named like the ledger column
is replaced. Only DataFrame functions are used, each row is judged on its own, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, let, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur more than once in the text."""
    zero = F.lit(0).cast("bigint")

    def windows(h: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        return F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))

    def repeated(s: Column) -> Column:
        """Places, ascending, of the windows in s (sorted by hash, then place) that equal a neighbour."""
        same = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        each = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(each, zero, lambda a, x: a + x)

    def total(win: Column) -> Column:
        # Most texts repeat nothing; only the others are sorted.
        twice = F.size(F.array_distinct(win)) < F.size(win)
        pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(twice, let(pairs, lambda s: let(repeated(s), covered))).otherwise(zero)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), total))


def _measures(text: Column) -> Column:
    length = lambda c: F.length(c).cast("bigint")
    without = lambda t, chars: length(t) - length(F.translate(t, chars, ""))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WS_CHARS, "")) > 0)
        by_line = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup")))
        by_word = let(words_of(t), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeat_words(w).alias("repeat")))
        named = lambda x, y: F.struct(
            y["n"].alias("n_words"),
            length(F.translate(t, WS_CHARS, "")).alias("word_chars"),
            without(t, SYMBOLS).alias("n_symbols"),
            x["n"].alias("n_lines"),
            x["dup"].alias("n_dup_lines"),
            y["repeat"].alias("n_repeat_words"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
            without(t, "!").alias("n_exclaim"),
        )
        return let(by_line, lambda x: let(by_word, lambda y: named(x, y)))

    return let(text_of(text), of)


#: Rules in bit order; each is a failure condition over the measurements.
RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda m: m["n_words"] < 20,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "word_length": lambda m: (m["n_words"] > 0) & ((m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    "symbols": lambda m: 4 * m["n_symbols"] > m["n_words"],
    "capitals": lambda m: 10 * m["n_upper"] > 6 * m["word_chars"],
    "exclamations": lambda m: 2 * m["n_exclaim"] > m["n_words"],
    "duplicate_lines": lambda m: (m["n_lines"] >= 4) & (2 * m["n_dup_lines"] > m["n_lines"]),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim")


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept if it fails none of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STRICT = Policy("strict-1", tuple(RULES))
POLICIES = {p.version: p for p in (BASE, STRICT)}


def ledger(df: DataFrame, text: str = "text", out: str = "ledger") -> DataFrame:
    """df with column `out`: struct of the measurements (long) and fail_bits (long)."""

    def entry(m: Column) -> Column:
        bits = F.lit(0).cast("bigint")
        for bit, rule in enumerate(RULES.values()):
            bits = bits.bitwiseOR(F.when(rule(m), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
        return F.struct(*[m[c].alias(c) for c in MEASURES], bits.alias("fail_bits"))

    return df.withColumn(out, let(_measures(F.col(f"`{text}`")), entry))


def kept(policy: Policy, out: str = "ledger") -> Column:
    """True where the document fails no rule of the policy."""
    return F.col(out)["fail_bits"].bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def ablations(judged: DataFrame, policies: dict[str, Policy] = POLICIES, out: str = "ledger") -> DataFrame:
    """(version, rule, n_docs, n_failing, n_rejected, n_only): what each rule of each policy adds.

    n_only counts the documents that only this rule rejects. Documents are first counted by bit pattern, of which there
    are 2 ** len(RULES) at most, whatever the size of the input.
    """
    spark = judged.sparkSession
    rows = [(p.version, r, p.mask, 1 << list(RULES).index(r)) for p in policies.values() for r in p.rules]
    chosen = spark.createDataFrame(rows, "version string, rule string, mask long, bit long")
    patterns = judged.groupBy(F.col(out)["fail_bits"].alias("bits")).agg(F.count("*").alias("n"))
    one = patterns.select(F.col("bits"), F.col("n"), F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule")) for v, r, _, _ in rows])).alias("k"))
    joined = one.select("bits", "n", "k.version", "k.rule").join(F.broadcast(chosen), ["version", "rule"])
    hit = F.col("bits").bitwiseAND(F.col("mask"))
    return joined.groupBy("version", "rule").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def filter_documents(df: DataFrame, policy: Policy = STRICT, text: str = "text") -> DataFrame:
    """The rows that the policy keeps, with the columns they came with."""
    return ledger(df, text, "_q_ledger").filter(kept(policy, "_q_ledger")).drop("_q_ledger")
