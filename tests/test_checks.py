"""Each kind of self-check on rows that keep it and rows that break it."""

import pytest

from helixloom.operators import checks as C
from helixloom.plans.checks import RULES, TABLES

RULES_TRIED = {
    "row": C.Row("a", "id", C.lacks("x", "y")),
    "text": C.Row("a", "id || '!'", C.but_not("x = 1", "y = 2")),
    "together": C.Row("a", "id", C.either_alone("x = 1", "y = 2")),
    "range": C.Row("a", "id", C.outside("x", 0, 5)),
    "orphan": C.Orphan("b", "ref", "a", "id", C.one_of("kind", "k", "l")),
    "pair": C.Pair("b", "ref", "a", "id", "a.v <> b.x"),
    "total": C.Group("b", "'sum'", "sum(v) <> 6"),
    "each": C.Group("b", "kind", "count(*) > 1", by="kind"),
    "missing": C.Orphan("b", "ref", "nowhere", "id"),
}


def test_kinds_of_rules(spark):
    a = spark.createDataFrame([("p", 1, 2), ("q", None, 2), ("r", 1, 3), ("s", 9, None)], "id string, x int, y int")
    b = spark.createDataFrame([("p", "k", 1), ("z", "k", 2), ("y", "m", 3), (None, "l", 0)], "ref string, kind string, v int")
    got = {r["rule"]: (r["status"], r["violations"], r["examples"]) for r in C.run(spark, {"a": a, "b": b}, RULES_TRIED).collect()}
    assert got["row"] == ("fail", 2, ["q", "s"])
    assert got["text"] == ("fail", 1, ["r!"])
    assert got["together"] == ("fail", 1, ["r"])  # an unknown side breaks nothing
    assert got["range"] == ("fail", 1, ["s"])
    assert got["orphan"][:2] == ("fail", 2) and "z" in got["orphan"][2]
    assert got["pair"] == ("pass", 0, [])
    assert got["total"] == ("pass", 0, []) and got["each"] == ("fail", 1, ["k"])
    assert got["missing"] == ("skipped", 0, []) and len(got) == len(RULES_TRIED)


def test_ten_keys_at_most_and_empty_tables(spark):
    many = spark.range(500).selectExpr("CAST(id AS STRING) AS id", "CAST(NULL AS INT) AS x", "1 AS y")
    r = C.run(spark, {"a": many}, {"row": C.Row("a", "id", C.lacks("x"))}).first()
    assert (r["violations"], len(r["examples"]), r["examples"][:2]) == (500, 10, ["0", "1"])
    assert C.run(spark, {"a": many.limit(0)}, {"row": C.Row("a", "id", "TRUE")}).first()["status"] == "pass"
    assert C.run(spark, {}, {"row": C.Row("a", "id", "TRUE")}).first()["status"] == "skipped"


@pytest.mark.parametrize("name", sorted(RULES))
def test_every_rule_reads_tables_that_are_there(name):
    assert set(RULES[name].needs) <= set(TABLES)


def test_every_rule_of_the_survey_has_a_name():
    assert len(RULES) >= 57
