"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

Documents are tokenised (in Arrow batches), closed with an end id, and cut into pieces of at most `capacity` ids. Documents
are dealt at random, row by row, into groups of about GROUP_TOKENS ids; each group is packed on its own: pieces by falling length,
each into the first sequence with room, found in a tournament tree that holds the largest room below each node. The
number of groups follows the input, so a group's size, the memory of a task and the share of padding do not. A row of
the packing holds lengths and checksums; ids travel along only if asked for.

Defined results: a null or empty text is the end id alone; repeated rows are packed one by one, each with a place of its
own; pieces of the same length keep no order; a very long text is encoded whole, in one task, and its pieces are one group
with those of others; an empty table gives an empty result. Columns of the input other than the key and the text are not
carried, so their names do not matter.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY = 4096
GROUP_TOKENS = 512 * 1024
CACHE = 1_200_000
_LOADED: dict = {}
_BY_WORDS: dict[str, bool] = {}
_WORDS: dict[str, dict[str, bytes]] = {}
_ENDS: dict[str, np.ndarray] = {}
WORD_END = "</w>"
#: Words of these letters are one token before and after normalisation: none is composed, decomposed or taken apart by it.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # all of ASCII but the apostrophe, which can begin a token of letters


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _tokenizer(path: str):
    if path not in _LOADED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def _encoded(texts: list[str], path: str) -> list[bytes]:
    t = _tokenizer(path)
    fast = getattr(t, "encode_batch_fast", t.encode_batch)
    return [array("I", e.ids).tobytes() for e in fast(texts, add_special_tokens=False)]


def _encoded_letters(words: list[str], path: str) -> list[bytes]:
    """Ids of words of letters only, many in one call: each ends with the one id that closes a word. A run of words with
    another number of such ids is encoded word by word."""
    if path not in _ENDS:
        vocabulary = _tokenizer(path).get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        ends[[i for w, i in vocabulary.items() if w.endswith(WORD_END)]] = True
        _ENDS[path] = ends
    out: list[bytes] = []
    runs = [words[k : k + 512] for k in range(0, len(words), 512)]
    for run, raw in zip(runs, _encoded([" ".join(run) for run in runs], path)):
        cuts = (4 * np.flatnonzero(_ENDS[path][np.frombuffer(raw, dtype=np.uint32)]) + 4).tolist()
        out += [raw[a:b] for a, b in zip([0, *cuts], cuts)] if len(cuts) == len(run) else _encoded(run, path)
    return out


def _encoded_words(words: list[str], path: str) -> list[bytes]:
    """Ids of each word: those of its LETTERS, then those of the marks of ASCII after them. Normalisation can join the letters of
    other scripts with what follows, so other words are encoded whole."""
    cores = [w.rstrip(MARKS) for w in words]
    plain = [LETTERS.fullmatch(c) is not None for c in cores]
    letters = list({c for c, p in zip(cores, plain) if p})
    rest = list({w[len(c) :] if p else w for w, c, p in zip(words, cores, plain)})
    of_letters, of_rest = dict(zip(letters, _encoded_letters(letters, path))), dict(zip(rest, _encoded(rest, path)))
    return [of_letters[c] + of_rest[w[len(c) :]] if p else of_rest[w] for w, c, p in zip(words, cores, plain)]


def goes_by_words(path: str) -> bool:
    """Whether the tokenizer closes each word with a mark of its own and drops white space, so that the ids of a text are those
    of its words in turn: told from its configuration, and tried on texts with white space of every kind."""
    if path not in _BY_WORDS:
        t = _tokenizer(path)
        suffix = json.loads(t.to_str())["model"].get("end_of_word_suffix")
        probes = [f"{x}{a}it's{b}, don't,{a}123{b}{a}" for x in ("", "a") for a in (" ", "\n", "  ") for b in (" ", " \n ")]
        whole, parts = _encoded(probes, path), [b"".join(_encoded(p.replace("\n", " ").split(" "), path)) for p in probes]
        _BY_WORDS[path] = suffix == WORD_END and whole == parts
    return _BY_WORDS[path]


def encode(texts: list[str], path: str, by_words: bool | None = None) -> list[bytes]:
    """Ids of each text, as native 32-bit integers. by_words: each word is encoded once and remembered, up to CACHE words
    in a worker; if it is not given, the tokenizer decides."""
    if not (goes_by_words(path) if by_words is None else by_words):
        return _encoded(texts, path)
    known = _WORDS.setdefault(path, {})
    if len(known) > CACHE:
        known.clear()
    split = [t.replace("\n", " ").split(" ") for t in texts]
    new = [w for w in set().union(*split) if w not in known]
    known.update(zip(new, _encoded_words(new, path)))
    return [b"".join(map(known.__getitem__, ws)) for ws in split]


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False, by_words: bool | None = None, seed: int = 7) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, deal[, ids binary]): documents cut into pieces, one row for each; `deal` is
    a random number that all pieces of a document share."""
    path = path or tokenizer_path()
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.iloc[lo : lo + 64]
                rows = []
                for k, deal, ids in zip(part["k"], part["deal"], encode(["" if t is None else t for t in part["t"]], path, by_words)):
                    ids += end
                    n = len(ids) // 4
                    for s in range(0, n, capacity):
                        raw = ids[4 * s : 4 * (s + capacity)]
                        rows.append((k, s, len(raw) // 4, zlib.crc32(raw), n, deal, *([raw] if with_ids else [])))
                out = pd.DataFrame(rows, columns=["k", "start", "length", "ids_crc32", "doc_tokens", "deal", *(["ids"] if with_ids else [])])
                out["k"] = out["k"].astype(b["k"].dtype)
                yield out

    kind = dict(df.dtypes)[key]
    schema = f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, deal double" + (", ids binary" if with_ids else "")
    slim = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"), F.rand(seed).alias("deal"))
    return slim.mapInPandas(cut, schema).withColumnRenamed("k", key)


class RoomTree:
    """Tournament tree of the room left in bins: the first bin with enough room, in logarithmic time."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Put a piece into the first bin it fits; returns the bin and the room it had before."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < length:
                i += 1
        before = room[i]
        b = i - self.leaves
        room[i] = before - length
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return b, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each length. First fit leaves at most one bin half empty, so twice the least number of bins
    is enough for the tree."""
    total = int(lengths.sum())
    tree = RoomTree(min(len(lengths), 2 * (-(-total // capacity)) + 1), capacity)
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        b, room = tree.place(int(lengths[i]))
        bins[i], offsets[i] = b, capacity - room
    return bins, offsets


def pack(cut: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """cut (as `pieces` gives it) with sequence_id and offset: where each piece stands."""
    cut = written(cut, "pieces")
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    dealt = cut.withColumn("group", F.floor(F.col("deal") * groups).cast("long")).drop("deal")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        g = int(pdf["group"].iloc[0])
        return pdf.drop(columns="group").assign(sequence_id=g * (1 << 24) + bins, offset=offsets)

    fields = ", ".join(f"`{n}` {t}" for n, t in cut.drop("deal").dtypes)
    return dealt.groupBy("group").applyInPandas(one, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame, pad_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, n_tokens, ids binary): the sequences themselves, little-endian 32-bit ids, padded to capacity except
    where their length is a power of two. Needs pieces that carry their ids."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = b"".join(pdf.sort_values("offset")["ids"])
        n = len(raw) // 4
        if n & (n - 1):
            raw += np.full(capacity - n, pad_id, dtype="<u4").tobytes()
        return pd.DataFrame({"sequence_id": [int(pdf["sequence_id"].iloc[0])], "n_tokens": [n], "ids": [raw]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(build, "sequence_id long, n_tokens long, ids binary")
