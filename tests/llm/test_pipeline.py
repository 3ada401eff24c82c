"""The pipeline, stage by stage, against what brute force keeps."""

import re
from collections import Counter

import corpus_pipeline
from helixloom.llm.common import written

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
    kept = {r["doc_id"]: r["text"] for r in seen["quality_rules"].collect()}
    assert all(len(re.findall(r"[^\x20\x09-\x0d]+", t)) >= 20 for t in kept.values())
    lines = Counter(x for r in seen["line_dedup"].collect() for x in r["text"].split("\n") if len(x) >= 20)
    assert max(lines.values()) == 1
    assert set(lines) <= {x for t in kept.values() for x in t.split("\n")}
    shingles = {}
    for r in seen["ngram_join"].collect():
        ws = r["text"].encode().lower().split()
        shingles[r["doc_id"]] = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}
    ids = sorted(shingles)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(shingles[a] & shingles[b])
            assert 100 * both < 80 * (len(shingles[a]) + len(shingles[b]) - both)
    packed = seen["packing"].collect()
    assert Counter(r["doc_id"] for r in seen["mixing"].collect()) == Counter(r["doc_id"] for r in packed if r["start"] == 0)
    assert all(4 * r["length"] == len(r["ids"]) for r in packed)


def test_run_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words " * 30, None, None, None), (3, " ".join(f"w{i}" for i in range(50)), "en", "a", 9), (3, " ".join(f"w{i}" for i in range(50)), "en", "a", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {3}
    (tmp_path / "e").mkdir()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0


def test_copies_leave_no_short_lines(spark):
    text = "Home\n" + " ".join(f"w{i}" for i in range(50)) + "\nContact"
    docs = spark.createDataFrame([(1, text, "en", "a", 9), (2, text, "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.lines(spark, docs, SF).collect()] == [1]


def test_remnants_of_near_copies_go(spark):
    """Copies with some lines changed: line dedup leaves remnants of all but the first, and none of them goes on."""
    import random

    rng = random.Random(5)
    sentence = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(12))
    base = [sentence() for _ in range(20)]
    rows = []
    for k in range(12):
        text = list(base)
        for _ in range(k):
            text[rng.randrange(20)] = sentence()
        rows.append((k, "\n".join(text), "en", "a", None))
    rows += [(100 + k, "\n".join([*(sentence() for _ in range(6)), base[0]]), "en", "b", None) for k in range(5)]  # others that share a line
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert {i for i in left if i < 100 and i < 8} == {0}
    assert {i for i in left if i >= 100} == set(range(100, 105))
    assert all(len(t.split()) >= 20 for t in left.values()) and left[0] == "\n".join(base)
