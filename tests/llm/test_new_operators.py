"""Importance resampling, conversation repair and fingerprints against brute force, with their edge cases; ids of all of Unicode,
and secrets behind names."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from helixloom.llm import conversation_repair, fingerprints, importance, ngram_join, packing, secret_scan, word_batch
from helixloom.llm import queries as Q
from helixloom.llm.oracles import OP11

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BIG = 2**53 + 1


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice("abcABC 019.,éß中\n\t") for _ in range(rng.randrange(300))) for _ in range(200)]
    return [*made, None, "", " ", "x" * 100 + " " + "x" * 100 + " " + "x" * 99, "ab " * 50, made[3], "İstanbul ﬀ \x00 a\x00b", "w " * 40_000]


def test_words_and_their_hashes(texts):
    w = word_batch.split(texts)
    got = [[w.buf[w.start[i] :][: w.size[i]].tobytes().decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(texts))]
    assert got == [WORD.findall(low(t)) for t in texts]
    for width in (1, 2, 5):
        start, size, text = w.grams(width)
        raw = [w.buf[a : a + n].tobytes() for a, n in zip(start, size)]
        want = [(k, " ".join(ws[i : i + width])) for k, ws in enumerate(got) for i in range(len(ws) - width + 1)]
        assert [(k, r.decode()) for k, r in zip(text, raw)] == want
        assert word_batch.xxh64(w.buf, start, size).tolist() == [xxhash.xxh64_intdigest(r) for r in raw]


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_equal_features_share_a_slot_and_others_never_do(texts, bits):
    w = word_batch.split(texts[:60])
    start, size, _ = w.grams(2)
    key = word_batch.xxh64(w.buf, start, size) & np.uint64((1 << bits) - 1)  # few bits: bytes decide
    slot, _ = importance.intern(w.buf, start, size, key)
    of = {}
    for k, a, n in zip(slot, start, size):
        assert of.setdefault(w.buf[a : a + n].tobytes(), k) == k
    assert len(set(of.values())) == len(of)


def test_bytes_are_compared_to_the_end():
    buf = np.frombuffer(b"a" * 90 + b"b" + b"a" * 90 + b"c" + b"\0" * 8, dtype=np.uint8)
    at, other = np.array([0, 0, 0, 1]), np.array([91, 91, 1, 92])
    assert word_batch.same_bytes(buf, at, other, np.array([91, 90, 90, 7])).tolist() == [False, True, False, True]


def resampled(rows, target, width, buckets, min_words, percent):
    def features(t):
        ws = WORD.findall(low(t))
        return [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, width + 1) for i in range(len(ws) - n + 1)]

    corpus, goal = Counter(b for _, t in rows for b in features(t)), Counter(b for t in target for b in features(t))
    s, t = sum(corpus.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((corpus[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        fs, h = features(text), int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in fs)
        out.append((i, len(WORD.findall(low(text))), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = [(*r, k) for k, r in enumerate(able[: len(able) * percent // 100], 1)]
    return Counter(drawn) + Counter((*r, None) for r in able[len(drawn) :]) + Counter((*r, None) for r in out if r[1] < min_words)


@pytest.mark.parametrize("width,buckets,min_words,percent", [(1, 10_000, 20, 10), (2, 50, 3, 60), (3, 7, 0, 100)])
def test_importance_resampling(spark, texts, width, buckets, min_words, percent):
    rows = [*((BIG + k, t) for k, t in enumerate(texts)), (None, "one two three " * 9), (None, None), (BIG, texts[0]), (5, texts[1]), (5, texts[2])]
    target = ["abc 019 c", None, "", texts[7]]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, id string, score string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(df, goal, width=width, buckets=buckets, min_words=min_words, percent=percent)
    assert Counter(map(tuple, found.collect())) == resampled(rows, target, width, buckets, min_words, percent)


def test_importance_resampling_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c " * 9)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert importance.resample(some, none, percent=100).first()["rank"] == 1


def test_importance_resampling_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(OP11)
    names = [x[0] for x in found.description]
    ours = Q.op11_importance_resampling(spark, SF)
    assert Counter(map(tuple, ours.select(names).collect())) == Counter(found.fetchall())


def test_tokens_behind_names_and_paths():
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    likely = {}
    for before in ["", "KEY=", "STRIPE_LIVE_CREDENTIAL=", "database_connection_string=", "N" * 40 + "=", "config/live/keys/", "/etc/Keys/"]:
        hits = 0
        for _ in range(300):
            token = "".join(rng.choice(letters) for _ in range(40))
            found = [c for c in secret_scan.candidates(f"x {before}{token} y") if c[1] == 2 + len(before) + 40]
            hits += any(c[0] == 2 + len(before) and c[4] >= secret_scan.BINS // 10 for c in found)
        likely[before] = hits / 300
    assert min(likely.values()) > 0.8
    assert secret_scan.candidates("a " + "Ab1" * 8 + "== b")[0][:2] == (2, 28)


@pytest.mark.parametrize("kind", ["all", "mixed"])
def test_ids_are_those_of_the_tokenizer(kind):
    path, rng = packing.tokenizer_path(), random.Random(3)
    points = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    if kind == "all":  # a letter, a mark and a space around each, and a mark that composes
        texts = [f(c) for c in points for f in (lambda c: f"a{c}b", lambda c: f"{c}, x", lambda c: f"x {c}\u0301 y", lambda c: f"{c}'s {c}{c}")]
    else:
        odd = [*"abcXYZ ,.'\n", "\u0130", "\u0958", "\u09dc", "\u0301", "\u093c", "\u0307", "\uac00", "\u1112", "\u1161", "ß", "Σ", "é"]
        texts = ["".join(rng.choice(odd) if rng.random() < 0.7 else rng.choice(points[:12_000]) for _ in range(60)) for _ in range(10_000)]
    for k in range(0, len(texts), 10_000):
        part = texts[k : k + 10_000]
        assert packing.encode(part, path) == packing.encode(part, path, by_words=False)


GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows, most, insert):
    """Least (cost, audit) and the repaired rows, by trying all edits that cost no more than `most`."""
    best = None

    def go(i, roles, audit, cost, out, inserts):
        nonlocal best
        if cost > most:
            return
        if i == len(rows) and GRAMMAR.match(roles) and (best is None or (cost, audit) < best[0]):
            best = ((cost, audit), out)
        if inserts < 2:
            for r in ("user", "assistant"):
                go(i, roles + r[0], audit + "I", cost + insert, [*out, f"{r}:"], inserts + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, roles, audit + "D", cost + 2, out, 0)
            if fault in ("", "truncated"):
                extra = 5 * (fault == "truncated")
                go(i + 1, roles + (role[:1] or "-"), audit + "K", cost + extra, [*out, f"{role}:{text}"], 0)
                for r in ("user", "assistant"):
                    go(i + 1, roles + r[0], audit + "R", cost + 1 + extra, [*out, f"{r}:{text}"], 0)

    go(0, "", "", 0, [], 0)
    return best


@pytest.mark.parametrize("insert", [5, 2, 1])
def test_cheapest_edits(monkeypatch, insert):
    monkeypatch.setattr(conversation_repair, "INSERT", insert)
    conversation_repair.steps.cache_clear()
    rng, faults = random.Random(insert), ["", "blank", "duplicate", "truncated"]
    for _ in range(150):
        rows = [(rng.choice(["system", "user", "user", "assistant", "tool", ""]), f"t{k}", rng.choice([0, 0, 0, 1, 2, 3])) for k in range(rng.randrange(6))]
        one = conversation_repair.Repair("c")
        for k, (role, text, fault) in enumerate(rows):
            one.add(str(k), role, text, fault)
        got = next(conversation_repair._backward(iter([conversation_repair.pd.DataFrame([one.spilled(last=True)], columns=conversation_repair.FORWARD)]))).iloc[0]
        (cost, audit), out = cheapest([(r, t, faults[f]) for r, t, f in rows], got["cost"], insert)
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    conversation_repair.steps.cache_clear()


def drilled(rows):
    """What the drill gives, row by row."""
    groups = {}
    for conv, turn, role, text in rows:
        live = groups.setdefault(conv, [])
        spaced = lambda x: " " if x is None else str(x)
        harm, role, text = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20, spaced(role), spaced(text)
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        if harm:
            live += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    out = {}
    for conv, live in groups.items():
        live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in live:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            judged.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns, initials = [r[0] for r in live if r[0] is not None], [r[0][:1] for r in judged]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n = Counter(f for _, _, f in judged)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal), judged
    return out


def rows_of_conversations():
    rng = random.Random(9)
    rows = []
    for conv in [*range(25), BIG, None]:
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), rng.choice(["user", "assistant", "system", None, "User", ""]), rng.choice([f"text {turn}.", "again!", "  ", None, "no end", "ends.\n \t"])))
    return [*rows, rows[0], rows[4], *((500 + k, k, "user", "x.") for k in range(60))]


def test_conversation_repair(spark):
    rows = rows_of_conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, _c_alive long, conv string").repartition(4)
    got = {r["conv_id"]: r for r in conversation_repair.drill(df).collect()}
    want = drilled(rows)
    assert set(got) == set(want)
    for conv, (counts, judged) in want.items():
        g = got[conv]
        assert tuple(g[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal")) == counts
        (cost, audit), out = cheapest(judged, g["cost"], 5)
        assert (g["cost"], g["audit"], g["repaired_sha256"]) == (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    dropped = [c for c, (_, judged) in want.items() if not judged]
    assert dropped and all(got[c]["audit"] == "" and got[c]["repaired_sha256"] == hashlib.sha256(b"").hexdigest() for c in dropped)


def test_spilled_blocks_change_nothing(spark, monkeypatch):
    turns = [(1, k, "user" if k % 3 else "assistant", f"t{k}." if k % 7 else f"t{k}") for k in range(3000)] + [(2, 1, "user", "a."), (2, 2, "assistant", "b.")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    whole = sorted(map(tuple, conversation_repair.repair(df).collect()))
    one = conversation_repair.Repair("c")
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", 16)
    batches = (conversation_repair.pd.DataFrame([(str(c), True, str(t), r, x, 0 if x.endswith(".") else 3) for c, t, r, x in turns[k : k + 50]], columns=["conv", "alive", "turn", "role", "text", "fault"]) for k in range(0, len(turns), 50))
    blocks = conversation_repair.pd.concat(list(conversation_repair._forward(batches)))
    assert len(blocks) > 3000 / 16 and max(map(len, blocks["back"])) == 16 * 4
    blocks = blocks.astype(object).sort_values(["conv", "block"], ascending=[True, False])
    found = conversation_repair.pd.concat(list(conversation_repair._backward(blocks.iloc[k : k + 7] for k in range(0, len(blocks), 7))))
    assert sorted((int(r[0]), *r[1:]) for r in found.itertuples(index=False)) == whole
    assert len(whole[0][7].replace("I", "")) == 3000 and one.states[0][0] == 0


def test_conversations_without_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.drill(df).count() == 0


def shingle_set(t, width=5):
    ws = (t or "").encode().lower().split()
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def family():
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(3, 300)) for _ in range(60)]
    for k in range(40):
        ws = texts[k % 5].split()
        for _ in range(k // 8):
            ws[rng.randrange(len(ws))] = f"n{k}"
        texts.append(" ".join(ws))
    return [*texts, "", None, "é ü 中文 😀 x", "One two", "one TWO", texts[0], "w " * 30_000, " ".join(map(str, range(30_000)))]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_fingerprints(spark, family, ranges):
    rows = [*((2 * BIG - 3 * k, t) for k, t in enumerate(family)), (None, "a null id comes first"), (7, "same id"), (7, "same id")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, known string").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = fingerprints.fingerprint(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    want = Counter()
    near = {}
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        key = (i, len(a), hashlib.sha256(e.encode()).hexdigest())
        want[key] += 1
        near[key] = (jaccard(shingle_set(a), shingle_set(e)), jaccard(shingle_set(a), shingle_set(b)), a, b, e)
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {}
    for r in got:
        x, y, a, _, e = near[(r["doc_id"], r["n_chars"], r["edited_sha256"])]
        assert abs(r["near_edited"] - x) < 0.2 and abs(r["near_next"] - y) < 0.2
        for text, found in ((a, r["fingerprint"]), (e, r["edited_fingerprint"])):
            assert prints.setdefault(text.encode().lower().decode() if text.isascii() else text, found) == found
            assert len(found) == 4 * fingerprints.PERMUTATIONS


def test_signatures_one_by_one(family):
    """The signature from its definition: the least value of each permutation."""
    texts = family[:12] + ["", "One two"]
    sig = fingerprints.signed(texts)
    for t, found in zip(texts, sig):
        h, _ = fingerprints.shingles([t])
        assert len(set(h.tolist())) == len(shingle_set(t))
        xs = [int(x) >> 32 for x in h]
        want = [min((x * int(a) + int(b)) % 2**32 for x in xs) & 0xFFFF if xs else 0xFFFF for a, b in zip(fingerprints._A, fingerprints._B)]
        assert found.tolist() == want


def test_likeness_is_unbiased():
    rng = random.Random(8)
    off = []
    for _ in range(60):
        ws = prose(rng, 200).split()
        other = ws[: rng.randrange(200)] + prose(rng, 60).split()
        a, b = " ".join(ws), " ".join(other)
        off.append(fingerprints.likeness(*(fingerprints.signed([t]) for t in (a, b)))[0] - jaccard(shingle_set(a), shingle_set(b)))
    assert abs(np.mean(off)) < 0.015 and np.max(np.abs(off)) < 0.16


def test_single_and_empty_tables(spark):
    one = spark.createDataFrame([(1, "only one text")], "doc_id long, text string")
    r = fingerprints.fingerprint(one).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"only oneonly o"[:7] + b"only o").hexdigest()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.fingerprint(none).count() == 0 and fingerprints.near_copies(none).count() == 0


def test_near_copies_by_bands(spark, family):
    rows = [*enumerate(family), (200, family[0])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cells string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in fingerprints.near_copies(df).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8]
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp and len(links) > 50
    assert got == {r["id"]: r["component_id"] for r in ngram_join.join(df, width=5, num=80, den=100).collect()}
