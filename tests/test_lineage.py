"""Paths through trees of descent, and what calls are made of them."""

import random

from helixloom.operators import lineage as L


def test_paths(spark):
    rng = random.Random(1)
    parent = {0: None} | {k: k - 1 if k < 40 else rng.randrange(k) for k in range(1, 200)}
    rows = [(f"n{k}", None if p is None else f"n{p}") for k, p in parent.items()]
    odd = [("x", "y"), ("y", "x"), ("z", "nowhere"), ("below z", "z"), ("root 2", None), ("n5", "n4"), (None, "n1")]
    got = {r["node"]: r["path"] for r in L.paths(spark.createDataFrame([*rows, *odd], "node string, parent string").repartition(3)).collect()}

    def up(k):
        return [] if k is None else [*up(parent[k]), f"n{k}"]

    assert got == {f"n{k}": up(k) for k in parent} | {"root 2": ["root 2"]}


def test_paternal(spark):
    tree = spark.createDataFrame([("A", None), ("B", "A"), ("C", "B"), ("D", "C")], "node string, parent string")
    calls = spark.createDataFrame([(1, "D*(xE)", 0.97, True), (2, "D", 0.97, False), (3, "C", 0.92, True), (4, "Q", 0.5, True), (5, "B", None, True)], "person int, call string, quality double, reads boolean")
    states = spark.createDataFrame([(1, "A", "D"), (1, "B", "D"), (1, "C", "A"), (2, "D", "D"), (3, "A", "A")], "person int, node string, state string")
    got = {r["person"]: (r["haplogroup"], r["call_level"], [(x["haplogroup"], x["state"]) for x in r["path"]]) for r in L.paternal(calls, tree, states).collect()}
    assert got[1] == ("B", "High", [("A", "D"), ("B", "D"), ("C", "A"), ("D", None)])
    assert got[2][:2] == ("D", "Medium")  # never High from a variant file alone
    assert got[3][:2] == ("C", "Medium") and got[4] == ("Q", "Low", []) and got[5][:2] == ("B", "Not callable")


def test_maternal(spark):
    hits = spark.createDataFrame([(1, 2, "H2", 0.8, "", "", ""), (1, 1, "H1", 0.91, "73G (x) nan 263G", None, "a (b) c (d)"), (2, None, "U", None, "nan", "-", None)], "person int, rank int, haplogroup string, quality double, found string, missing string, remaining string")
    got = {r["person"]: r for r in L.maternal(hits).collect()}
    assert (got[1]["haplogroup"], got[1]["call_level"], got[1]["found"], got[1]["missing"], got[1]["extra"]) == ("H1", "High", ["73G", "263G"], [], ["a (b", "c (d)"])
    assert [tuple(a) for a in got[1]["alternatives"]] == [("H2", 0.8)]
    assert got[2]["call_level"] == "Not callable" and got[2]["found"] == [] and got[2]["missing"] == [] and got[2]["alternatives"] == []
