"""Secret scans: fixed patterns, and a battery of randomness tests for tokens that no pattern names.

Base kinds are regular expressions. Other runs of MIN_LENGTH token characters or more are tested. An equals sign ends a run
(as padding it may close one), so a value is judged without the name before it, and so is what follows a path of words. A run's encoding is inferred from its characters (hex, base32, base64), then four tests ask whether it
looks like random symbols of that alphabet: chi-squared of symbol counts against the uniform, a runs test about the
alphabet's middle, the serial correlation of neighbouring symbols, and the number of equal pairs. The smallest of the four
p-values is compared with those of SIMULATED random tokens of the same encoding and length (seeded, and the same in every
worker); its rank among them, ties broken by a hash of the token, is the token's p-value. So it is spread evenly over 0 to
1 for random tokens, whatever the four tests have in common, and near 0 for words and identifiers.

Which tokens to report is decided over the corpus, for each encoding and length class apart: the number of random tokens
is read off the upper half of the p-values, and the threshold is the smallest at which the expected share of false
discoveries is at most `fdr`. P-values are counted in BINS bins, so the table of thresholds has a bounded number of rows
(encodings x length classes x bins), whatever the input. A first pass over the texts counts, a second one reports; texts
are not written anywhere and other columns stay in the JVM.

Defined results: a null text counts as empty (no spans); repeated rows are scanned one by one, and count as often for the
thresholds; very long texts are scanned whole; an empty table gives an empty result; other columns stay, and a column
already named like the output is replaced. Offsets are code points.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base patterns, in the order in which spans of the same start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_LENGTH = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?" % MIN_LENGTH)
PATH = re.compile(r"/?(?:(?:[a-z_-]{3,}|[A-Z][a-z]{2,})/){2,}")  # random tokens hardly ever begin with two such parts

BINS, SIMULATED = 200, 1999
ALPHABETS = (16, 32, 64)
SPAN = "struct<start:int,kind:int,`end`:int>"
SPANS = f"struct<base:array<{SPAN}>,spans:array<{SPAN}>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds: leftmost, non-overlapping within a kind, failing matches dropped."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def encode(token: str) -> tuple[int, np.ndarray, int]:
    """Inferred encoding (0 hex, 1 base32, 2 base64), the token's symbols as numbers, and the alphabet's size."""
    b = np.frombuffer(token.rstrip("=").encode("ascii"), dtype=np.uint8).astype(np.int64)
    digit, lower, upper = (b >= 48) & (b <= 57), (b >= 97) & (b <= 122), (b >= 65) & (b <= 90)
    if np.all(digit | ((b >= 97) & (b <= 102))) or np.all(digit | ((b >= 65) & (b <= 70))):
        return 0, np.where(digit, b - 48, (b & 31) + 9), 16
    if np.all(upper | ((b >= 50) & (b <= 55))):
        return 1, np.where(upper, b - 65, b - 24), 32
    return 2, np.where(upper, b - 65, np.where(lower, b - 71, np.where(digit, b + 4, np.where((b == 43) | (b == 45), 62, 63)))), 64


def _upper_tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the normal distribution (Abramowitz and Stegun 7.1.26; the simulated ranks make up for its error)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.where(z > 0, tail, 1 - tail)


def battery(rows: np.ndarray, alphabet: int) -> np.ndarray:
    """Smallest p-value of the four tests for each row of symbols."""
    m, n = rows.shape
    classes = max(2, min(alphabet, n // 4))  # chi-squared over as many equal classes as the length allows
    while alphabet % classes:
        classes -= 1
    counts = np.bincount((np.arange(m)[:, None] * alphabet + rows).ravel(), minlength=m * alphabet).reshape(m, alphabet).astype(float)
    by_class = counts.reshape(m, classes, -1).sum(axis=2)
    dof = classes - 1
    chi2 = ((by_class - n / classes) ** 2).sum(axis=1) * classes / n
    uniform = _upper_tail(((chi2 / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / np.sqrt(2 / (9 * dof)))
    high = rows >= alphabet // 2
    a = high.sum(axis=1).astype(float)
    both = np.maximum(a * (n - a), 1e-9)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    var = np.maximum(2 * both * (2 * both - n) / (n * n * (n - 1)), 1e-9)
    by_runs = 2 * _upper_tail(np.abs(runs - (1 + 2 * both / n)) / np.sqrt(var))
    x = rows - rows.mean(axis=1, keepdims=True)
    total = (x * x).sum(axis=1)
    r = np.where(total > 0, (x[:, 1:] * x[:, :-1]).sum(axis=1) / np.maximum(total, 1e-9), 1.0)
    serial = 2 * _upper_tail(np.abs(r + 1 / n) * np.sqrt(n))
    expect = n * (n - 1) / 2 / alphabet
    pairs = _upper_tail(((counts * (counts - 1) / 2).sum(axis=1) - expect) / np.sqrt(max(expect * (1 - 1 / alphabet), 1e-9)))
    return np.minimum(np.minimum(uniform, by_runs), np.minimum(serial, pairs))


@lru_cache(maxsize=4096)
def simulated(encoding: int, length: int) -> np.ndarray:
    """Sorted battery results of random tokens."""
    rng, size = np.random.default_rng([encoding, length]), ALPHABETS[encoding]
    rows = max(1, 100_000 // length)  # at once
    return np.sort(np.concatenate([battery(rng.integers(0, size, (min(rows, SIMULATED - k), length)), size) for k in range(0, SIMULATED, rows)]))


def length_like(n: int) -> int:
    """The length whose simulation stands for n: n itself up to 64, then steps of an eighth, up to 1024."""
    step = 1 << max(0, n.bit_length() - 4)
    return n if n <= 64 else min(n // step * step, 1024)


def p_value(token: str) -> tuple[int, float]:
    """Encoding, and p-value of the hypothesis that the token is random."""
    enc, symbols, size = encode(token)
    if len(symbols) < 8:
        return enc, 0.0
    null = simulated(enc, length_like(len(symbols)))
    found = battery(symbols[None, :], size)[0]
    below, upto = np.searchsorted(null, found - 1e-12), np.searchsorted(null, found + 1e-12, "right")
    u = (zlib.crc32(token.encode()) + 0.5) / 2**32
    return enc, float((below + u * (upto - below + 1)) / (SIMULATED + 1))


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, end, encoding, length class, bin) of the tokens that are tested."""
    out = []
    for m in TOKEN.finditer(text):
        path = PATH.match(m.group())
        token = m.group()[path.end() :] if path else m.group()
        if len(token) < MIN_LENGTH or (token.isalpha() and (token.islower() or token.istitle())):
            continue  # small letters alone never look uniform over base64; those in upper case can be base32
        enc, p = p_value(token)
        out.append((m.end() - len(token), m.end(), enc, int(np.log2(len(token))), min(BINS - 1, int(p * BINS))))
    return out


def reported(text: str, least: dict[tuple[int, int], int]) -> tuple[list, list]:
    """Base spans, and all spans: those and the tokens that pass the thresholds and overlap no base span."""
    base = base_spans(text)
    more = []
    if least:
        ends = list(accumulate((e for _, _, e in base), max))
        for start, end, enc, cls, b in candidates(text):
            k = bisect_left(base, (end, -1, -1))  # base spans that begin before the token's end
            if b >= least.get((enc, cls), BINS) and (not k or ends[k - 1] <= start):
                more.append((start, 3, end))
    return base, sorted(base + more)


def thresholds(cands: DataFrame, fdr: float) -> dict[tuple[int, int], int]:
    """Smallest bin to report for each (encoding, length class); from a histogram of bounded size."""
    rows = cands.groupBy("enc", "len_class", "bin").agg(F.sum("n").alias("n")).collect()
    out = {}
    for key in sorted({(r["enc"], r["len_class"]) for r in rows}):
        h = np.zeros(BINS)
        for r in rows:
            if (r["enc"], r["len_class"]) == key:
                h[r["bin"]] += r["n"]
        random = 2 * h[BINS // 2 :].sum()  # random tokens spread evenly, others do not reach the upper half
        at_least = h[::-1].cumsum()[::-1]
        true = np.minimum(at_least, random * (BINS - np.arange(BINS)) / BINS)
        good = np.flatnonzero((at_least > 0) & (1 - true / np.maximum(at_least, 1) <= fdr))
        good = good[good >= 1]  # p near 0 is never reported
        if len(good):
            out[key] = int(good[0])
    return out


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(enc, len_class, bin, n) of the candidates of each batch."""
    for b in batches:
        n = Counter(c[2:] for t in b["t"] if t is not None for c in candidates(t))
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["enc", "len_class", "bin", "n"])


def scan(df: DataFrame, text: str = "text", out: str = "secrets", fdr: float = 0.05) -> DataFrame:
    """df with column `out`: struct(base array<span>, spans array<span>), a span being (start, kind, end), sorted.

    Spans of kind `random` (3) are tokens that pass the battery and overlap no base span.
    """
    t = F.col(f"`{text}`").cast("string")
    least = thresholds(df.select(t.alias("t")).mapInPandas(_counted, "enc int, len_class int, bin int, n long"), fdr)

    def spans(texts: pd.Series) -> pd.DataFrame:
        found = [reported("" if x is None else x, least) for x in texts]
        return pd.DataFrame({"base": [a for a, _ in found], "spans": [b for _, b in found]})

    return df.withColumn(out, F.pandas_udf(spans, SPANS)(t))


def as_text(spans):
    """kind:start:end, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
