"""Queries over a reference panel: people with components (the first ten dimensions of their vectors) and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adjust as A
from ..operators import panel as P
from ..operators.storage import stored
from .registry import query

LONG = "p AS (SELECT vec_id, label, label % 3 AS grp, [x::DOUBLE FOR x IN embedding[1:10]] AS pc FROM embeddings), l AS (SELECT vec_id, label, grp, unnest(range(1, 11)) AS axis, unnest(pc) AS x FROM p)"


@query("axis_spread", f"""WITH {LONG}, m AS (SELECT *, avg(x) OVER (PARTITION BY grp, label, axis) AS mean_pop, avg(x) OVER (PARTITION BY grp, axis) AS mean_grp FROM l),
 v AS (SELECT grp, axis, sum((x - mean_pop) * (x - mean_pop)) AS within, sum((mean_pop - mean_grp) * (mean_pop - mean_grp)) AS between FROM m GROUP BY 1, 2), r AS (SELECT *, between / CASE WHEN within = 0 THEN 1 ELSE within END AS ratio FROM v)
 SELECT grp, axis::INT AS axis, round(within, 6) AS within, round(between, 6) AS between, round(ratio, 6) AS ratio, row_number() OVER (PARTITION BY grp ORDER BY ratio DESC, axis)::INT AS rank FROM r""")
def _(t):
    spread = P.axis_spread(P.long_axes(P.people(t.embeddings)))
    return spread.select("grp", "axis", *[F.round(c, 6).alias(c) for c in ("within", "between", "ratio")], "rank")


def _knn(axes):
    cut = f"[1:{axes}]"
    return f"""sd AS (SELECT grp, axis, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd FROM l GROUP BY 1, 2), z AS (SELECT vec_id, label, grp, list(x / sd ORDER BY axis){cut} AS pc FROM l JOIN sd USING (grp, axis) GROUP BY 1, 2, 3),
 nn AS (SELECT a.vec_id, a.label AS own, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.pc, b.pc), b.vec_id) AS k FROM z a JOIN z b ON a.grp = b.grp AND a.vec_id <> b.vec_id),
 vo AS (SELECT vec_id, own, other, count(*) AS n FROM nn WHERE k <= 10 GROUP BY 1, 2, 3), ca AS (SELECT vec_id, own, other AS called FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, other) AS k FROM vo) WHERE k = 1)"""


@query("neighbour_confusion", f"WITH {LONG}, {_knn(10)} SELECT own, called, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY own) AS share FROM ca GROUP BY 1, 2")
def _(t):
    return P.confusion(P.neighbour_votes(P.scaled(P.people(t.embeddings))))


@query("best_axes", "WITH " + LONG + ", " + ", ".join(f"b{k} AS (WITH {_knn(k)} SELECT {k} AS axes, avg((own = called)::INT) AS accuracy FROM ca)" for k in P.AXES_TRIED) + ", a AS (" + " UNION ALL ".join(f"SELECT * FROM b{k}" for k in P.AXES_TRIED) + ") SELECT axes, accuracy, row_number() OVER (ORDER BY accuracy DESC, axes) = 1 AS best FROM a")
def _(t):
    z = stored(P.scaled(P.people(t.embeddings)), "scaled")
    rows = None
    for k in P.AXES_TRIED:
        one = P.neighbour_votes(z, axes=k).agg(F.avg((F.col("own") == F.col("called")).cast("int")).alias("accuracy")).select(F.lit(k).alias("axes"), "accuracy")
        rows = one if rows is None else rows.union(one)
    top = rows.agg(F.max_by("axes", F.struct("accuracy", -F.col("axes"))).alias("top"))
    return rows.join(top).select("axes", "accuracy", (F.col("axes") == F.col("top")).alias("best"))


@query("confusable_groups", f"""WITH RECURSIVE {LONG}, {_knn(10)}, cf AS (SELECT own, called, count(*) / sum(count(*)) OVER (PARTITION BY own) AS share FROM ca GROUP BY 1, 2), li AS (SELECT own AS a, called AS b FROM cf WHERE share >= 0.2 UNION SELECT called, own FROM cf WHERE share >= 0.2 UNION SELECT label, label FROM p),
 re(a, b) AS (SELECT a, b FROM li UNION SELECT re.a, li.b FROM re JOIN li ON re.b = li.a) SELECT a AS population, min(b) AS grp_of FROM re GROUP BY 1""")
def _(t):
    return P.confusable(P.confusion(P.neighbour_votes(P.scaled(P.people(t.embeddings)))))


@query("group_centres", f"WITH {LONG} SELECT grp, axis::INT AS axis, count(*) AS n, avg(x) AS centre FROM l GROUP BY 1, 2")
def _(t):
    return P.long_axes(P.people(t.embeddings)).groupBy("grp", "axis").agg(F.count("*").alias("n"), F.avg("x").alias("centre"))


@query("leave_one_out_distance", f"WITH {LONG}, c AS (SELECT grp, axis, count(*) AS n, sum(x) AS s FROM l GROUP BY 1, 2) SELECT vec_id, sqrt(sum(((c.s - l.x) / (c.n - 1) - l.x) * ((c.s - l.x) / (c.n - 1) - l.x))) AS distance FROM l JOIN c USING (grp, axis) GROUP BY 1")
def _(t):
    return P.leave_one_out(P.long_axes(P.people(t.embeddings)))


@query("group_percentile", f"WITH {LONG} SELECT vec_id, grp, percent_rank() OVER (PARTITION BY grp ORDER BY pc[1]) AS share_below FROM p")
def _(t):
    p = P.people(t.embeddings).select("vec_id", "grp", F.get("pc", F.lit(0)).alias("x"))
    return P.percentile_below(p, "grp", "x").select("vec_id", "grp", "share_below")


@query("nearest_centre_confusion", f"""WITH {LONG}, c AS (SELECT grp, axis, count(*) AS n, sum(x) AS s FROM l GROUP BY 1, 2), d AS (SELECT l.vec_id, l.grp AS own, c.grp, sum((l.x - CASE WHEN l.grp = c.grp THEN (c.s - l.x) / (c.n - 1) ELSE c.s / c.n END) * (l.x - CASE WHEN l.grp = c.grp THEN (c.s - l.x) / (c.n - 1) ELSE c.s / c.n END)) AS dd FROM l JOIN c USING (axis) GROUP BY 1, 2, 3),
 b AS (SELECT vec_id, own, arg_min(grp, dd) AS called FROM d GROUP BY 1, 2) SELECT own, called, count(*) AS n FROM b GROUP BY 1, 2""")
def _(t):
    return P.nearest_centre(P.long_axes(P.people(t.embeddings))).groupBy("own", "called").agg(F.count("*").alias("n"))


#: People against three centres, their own group's without them; every support in closed form, the nearest valid point wins.
SHARES = f"""WITH {LONG}, c AS (SELECT grp, axis, count(*) AS n, sum(x) AS s FROM l GROUP BY 1, 2), k AS (SELECT l.vec_id, l.grp AS own, c.grp AS j, l.axis, l.x, CASE WHEN l.grp = c.grp THEN (c.s - l.x) / (c.n - 1) ELSE c.s / c.n END AS m FROM l JOIN c USING (axis)),
 w AS (SELECT vec_id, own, axis, x, max(m) FILTER (j = 0) AS m0, max(m) FILTER (j = 1) AS m1, max(m) FILTER (j = 2) AS m2 FROM k GROUP BY 1, 2, 3, 4),
 g AS (SELECT vec_id, own, sum(m0 * m0) AS g00, sum(m0 * m1) AS g01, sum(m0 * m2) AS g02, sum(m1 * m1) AS g11, sum(m1 * m2) AS g12, sum(m2 * m2) AS g22, sum(m0 * x) AS b0, sum(m1 * x) AS b1, sum(m2 * x) AS b2, sum(x * x) AS xx FROM w GROUP BY 1, 2),
 t AS (SELECT *, ((g00 - g01) - (b0 - b1)) / (g00 - 2 * g01 + g11) AS t01, ((g00 - g02) - (b0 - b2)) / (g00 - 2 * g02 + g22) AS t02, ((g11 - g12) - (b1 - b2)) / (g11 - 2 * g12 + g22) AS t12,
  g11 - 2 * g01 + g00 AS p, g22 - 2 * g02 + g00 AS q, g12 - g01 - g02 + g00 AS o, (b1 - b0) - (g01 - g00) AS r1, (b2 - b0) - (g02 - g00) AS r2 FROM g), u AS (SELECT *, (r1 * q - r2 * o) / (p * q - o * o) AS u, (r2 * p - r1 * o) / (p * q - o * o) AS v FROM t),
 s AS (SELECT *, unnest([{{'i': 1, 'a': 1.0::DOUBLE, 'b': 0.0::DOUBLE, 'c': 0.0::DOUBLE}}, {{'i': 2, 'a': 0, 'b': 1, 'c': 0}}, {{'i': 3, 'a': 0, 'b': 0, 'c': 1}}, {{'i': 4, 'a': 1 - t01, 'b': t01, 'c': 0}}, {{'i': 5, 'a': 1 - t02, 'b': 0, 'c': t02}}, {{'i': 6, 'a': 0, 'b': 1 - t12, 'c': t12}}, {{'i': 7, 'a': 1 - u - v, 'b': u, 'c': v}}]) AS z FROM u),
 e AS (SELECT vec_id, own, z, z.a * z.a * g00 + z.b * z.b * g11 + z.c * z.c * g22 + 2 * (z.a * z.b * g01 + z.a * z.c * g02 + z.b * z.c * g12) - 2 * (z.a * b0 + z.b * b1 + z.c * b2) + xx AS gap FROM s WHERE least(z.a, z.b, z.c) >= -1e-9),
 f AS (SELECT vec_id, own AS grp, z FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY gap, z.i) AS r FROM e) WHERE r = 1), sh AS (SELECT vec_id, grp, [greatest(z.a, 0), greatest(z.b, 0), greatest(z.c, 0)] AS shares FROM f)"""


@query("ancestry_shares", f"{SHARES} SELECT vec_id, grp, shares FROM sh")
def _(t):
    return P.ancestry_shares(P.people(t.embeddings))


@query("noise_floors", " UNION ALL ".join(f"({SHARES} SELECT {g}::BIGINT AS grp, quantile_cont(shares[{g + 1}], 0.95) FILTER (grp <> {g}) AS floor, avg(shares[{g + 1}]) FILTER (grp = {g}) AS own FROM sh)" for g in range(3)))
def _(t):
    return P.noise_floors(P.ancestry_shares(P.people(t.embeddings)))


@query("share_grades", "SELECT case_id, ['Limited', 'Moderate', 'Strong'][e + 1] AS evidence, ['Not callable', 'Limited', 'Moderate', 'Strong'][least(e + 1, level) + 1] AS overall FROM (SELECT case_id, level, CASE WHEN ratio_all / 2 <= gc THEN 0 WHEN ratio_all / 2 >= 0.5 THEN 2 ELSE 1 END AS e FROM fx_cases WHERE gc IS NOT NULL)")
def _(t):
    from ..functions import evidence as E

    e, o = P.grade_shares(F.col("ratio_all") / 2, F.col("gc"), F.col("level"))
    return t.fx_cases.filter("gc IS NOT NULL").select("case_id", E.word(e, E.EVIDENCE).alias("evidence"), E.word(o, E.OVERALL).alias("overall"))


@query("twin_check", f"WITH {LONG}, {_knn(10)}, cf AS (SELECT own, called, count(*) / sum(count(*)) OVER (PARTITION BY own) AS share FROM ca GROUP BY 1, 2) SELECT a, b, greatest(coalesce((SELECT share FROM cf WHERE own = a AND called = b), 0), coalesce((SELECT share FROM cf WHERE own = b AND called = a), 0)) < 0.2 AS told_apart FROM (SELECT DISTINCT label AS a, label + 3 AS b FROM embeddings WHERE label < 7)")
def _(t):
    twins = t.embeddings.filter("label < 7").select(F.col("label").alias("a"), (F.col("label") + 3).alias("b")).distinct()
    return P.twin_check(P.confusion(P.neighbour_votes(P.scaled(P.people(t.embeddings)))), twins)


@query("score_in_group", f"WITH {LONG} SELECT vec_id, grp, (pc[2] - avg(pc[2]) OVER w) / stddev_samp(pc[2]) OVER w AS z, 100 * percent_rank() OVER (PARTITION BY grp ORDER BY pc[2]) AS percentile FROM p WINDOW w AS (PARTITION BY grp)")
def _(t):
    s = P.people(t.embeddings).select("vec_id", "grp", F.get("pc", F.lit(1)).alias("score"))
    return P.score_in_group(s, s)


ADJUST = "WITH " + LONG + """, y AS (SELECT vec_id, pc[1] AS x, unnest(['A', 'B']) AS score_id, unnest([pc[2] + pc[1] * (1 + pc[3]), pc[3] - 2 * pc[1]]) AS score, vec_id % 5 <> 0 AS reference FROM p),
 f AS (SELECT score_id, regr_slope(score, x) AS b, regr_intercept(score, x) AS a FROM y WHERE reference GROUP BY 1), r AS (SELECT y.*, score - (a + b * x) AS r FROM y JOIN f USING (score_id)), g AS (SELECT score_id, regr_slope(r * r, x) AS d, regr_intercept(r * r, x) AS c, sqrt(avg(r * r)) AS sd FROM r WHERE reference GROUP BY 1)
 SELECT vec_id, score_id, r / sd AS z_norm1, CASE WHEN c + d * x > 0 THEN r / sqrt(c + d * x) END AS z_norm2 FROM r JOIN g USING (score_id)"""


def _scored(t):
    x = lambda i: F.get("pc", F.lit(i))
    both = F.array(F.struct(F.lit("A").alias("score_id"), (x(1) + x(0) * (1 + x(2))).alias("score")), F.struct(F.lit("B").alias("score_id"), (x(2) - 2 * x(0)).alias("score")))
    return P.people(t.embeddings).select("vec_id", "pc", (F.col("vec_id") % 5 != 0).alias("reference"), F.inline(both))


@query("scores_adjusted", ADJUST)
def _(t):
    return A.adjusted(_scored(t), 1).select("vec_id", "score_id", "z_norm1", "z_norm2")


@query("scores_adjusted_by_four")
def _(t):
    return A.adjusted(_scored(t)).select("vec_id", "score_id", "z_norm1", "z_norm2")


@query("population_similarity")
def _(t):
    people = P.people(t.embeddings).select("vec_id", F.col("grp").alias("population"), "pc", (F.col("vec_id") % 5 != 0).alias("reference"))
    return A.population_similarity(people).select("vec_id", "population", "reference", "called", "probability")
