"""Queries of lines of descent, over a tree and calls made of the tables' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage as L
from .matching import read
from .registry import query

#: A tree over parts: a part hangs below the part of half its key; the first is the root, and one branch hangs in the air.
TREE = "SELECT 'H' || CAST(p_partkey AS STRING) AS node, CASE WHEN p_partkey > 1 THEN 'H' || CAST(CASE WHEN p_partkey = 48 THEN -1 ELSE CAST(floor(p_partkey / 2) AS BIGINT) END AS STRING) END AS parent FROM part"
CALLS = "SELECT c_custkey AS person, 'H' || CAST(1 + c_custkey * 7 % 260 AS STRING) || CASE WHEN c_custkey % 3 = 0 THEN '*(xH9)' ELSE '' END AS call, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 40 AS DOUBLE) / 200 + 0.8 END AS quality, c_custkey % 2 = 0 AS reads FROM customer"
STATES = "SELECT o_custkey AS person, 'H' || CAST(o_orderkey % 130 + 1 AS STRING) AS node, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'D' END AS state FROM orders"
HITS = """SELECT c_custkey AS person, CAST(h.h AS INT) AS rank, 'M' || CAST((c_custkey * h.h) % 77 AS STRING) AS haplogroup, CAST(100 - h.h * 7 - c_custkey % 20 AS DOUBLE) / 100 AS quality,
  CASE WHEN c_custkey % 5 = 0 THEN 'nan' ELSE '73G ' || CAST(c_custkey AS STRING) || 'T (note) 263G' END AS found, CASE WHEN h.h = 2 THEN NULL ELSE '152C  195C' END AS missing, '16519C (hotspot) 310C (local)' AS remaining FROM customer CROSS JOIN (VALUES (1), (2), (3)) AS h(h) WHERE c_custkey % 4 >= h.h - 1"""


@query("descent_paths", f"WITH RECURSIVE t AS ({TREE}), w(node, path) AS (SELECT node, [node] FROM t WHERE parent IS NULL UNION ALL SELECT t.node, list_append(w.path, t.node) FROM t JOIN w ON t.parent = w.node) SELECT node, path FROM w")
def _(t):
    return L.paths(read(t, TREE))


@query("paternal_lines", f"""WITH RECURSIVE t AS ({TREE}), w(node, path) AS (SELECT node, [node] FROM t WHERE parent IS NULL UNION ALL SELECT t.node, list_append(w.path, t.node) FROM t JOIN w ON t.parent = w.node), c AS (SELECT *, split_part(call, '*', 1) AS node FROM ({CALLS})),
 s AS (SELECT person, node, max(state) AS state FROM ({STATES}) GROUP BY 1, 2), x AS (SELECT c.*, w.path FROM c LEFT JOIN w USING (node)), e AS (SELECT person, unnest(path) AS node, unnest(range(0, len(path))) AS i FROM x),
 p AS (SELECT e.person, list({{'haplogroup': e.node, 'state': s.state}} ORDER BY i) AS path, arg_max(e.node, i) FILTER (s.state = 'D') AS last FROM e LEFT JOIN s ON s.person = e.person AND s.node = e.node GROUP BY 1)
 SELECT x.person, x.call, coalesce(p.last, x.node) AS haplogroup, x.quality, CASE WHEN quality IS NULL THEN 'Not callable' WHEN quality >= 0.95 THEN CASE WHEN reads THEN 'High' ELSE 'Medium' END WHEN quality >= 0.9 THEN 'Medium' ELSE 'Low' END AS call_level, array_to_string([z.haplogroup || coalesce(':' || z.state, '') FOR z IN coalesce(p.path, [])], '>') AS path FROM x LEFT JOIN p USING (person)""")
def _(t):
    found = L.paternal(read(t, CALLS), read(t, TREE), read(t, STATES))
    return found.withColumn("path", F.array_join(F.transform("path", lambda z: F.concat(z["haplogroup"], F.coalesce(F.concat(F.lit(":"), z["state"]), F.lit("")))), ">"))


@query("maternal_lines", f"""WITH h AS ({HITS}), r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY rank, haplogroup) AS k FROM h)
 SELECT person, haplogroup, quality, CASE WHEN quality >= 0.9 THEN 'High' WHEN quality >= 0.8 THEN 'Medium' ELSE 'Low' END AS call_level, CASE WHEN found = 'nan' THEN [] ELSE ['73G', person || 'T', '263G'] END AS found, CASE WHEN missing IS NULL THEN [] ELSE ['152C', '195C'] END AS missing, ['16519C (hotspot', '310C (local)'] AS extra,
  coalesce((SELECT string_agg(o.haplogroup || '=' || o.quality, ',' ORDER BY o.k) FROM r o WHERE o.person = r.person AND o.k > 1), '') AS alternatives FROM r WHERE k = 1""")
def _(t):
    found = L.maternal(read(t, HITS))
    return found.withColumn("alternatives", F.array_join(F.transform("alternatives", lambda a: F.concat(a["haplogroup"], F.lit("="), a["quality"].cast("string"))), ","))
