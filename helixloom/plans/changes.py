"""Queries that compare versions, check tables, and search texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators.windows import top_per
from .registry import query

FIELDS = ["section", "gene", "overall", "stars", "statement"]
CMP = """j AS (SELECT coalesce(o.claim_id, n.claim_id) AS claim_id, o.claim_id AS was, n.claim_id AS now, list_filter([CASE WHEN o.section IS DISTINCT FROM n.section THEN 'section' END, CASE WHEN o.gene IS DISTINCT FROM n.gene THEN 'gene' END,
 CASE WHEN o.overall IS DISTINCT FROM n.overall THEN 'overall' END, CASE WHEN o.stars IS DISTINCT FROM n.stars THEN 'stars' END, CASE WHEN o.statement IS DISTINCT FROM n.statement THEN 'statement' END], lambda x: x IS NOT NULL) AS fields
 FROM fx_claims_old o FULL JOIN fx_claims_new n ON o.claim_id = n.claim_id),
 d AS (SELECT claim_id, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN len(fields) > 0 THEN 'changed' END AS kind, CASE WHEN was IS NOT NULL AND now IS NOT NULL THEN fields END AS changed FROM j WHERE was IS NULL OR now IS NULL OR len(fields) > 0),
 g AS (SELECT *, CASE WHEN kind = 'changed' THEN CASE WHEN list_contains(changed, 'overall') OR list_contains(changed, 'stars') THEN 'regraded' ELSE 'reworded' END ELSE kind END AS what FROM d)"""


def _diff(t):
    return C.snapshot_compare(t.fx_claims_old, t.fx_claims_new, ["claim_id"], FIELDS)


@query("claim_diff", f"WITH {CMP} SELECT * FROM g")
def _(t):
    return C.graded_diff(_diff(t))


@query("change_counts", f"WITH {CMP} SELECT what, count(*) AS n FROM g GROUP BY 1")
def _(t):
    return C.graded_diff(_diff(t)).groupBy("what").agg(F.count("*").alias("n"))


@query("top_changes_per_kind", f"WITH {CMP} SELECT claim_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY claim_id) AS k FROM d) WHERE k <= 50")
def _(t):
    return top_per(_diff(t), ["kind"], ["claim_id"], 50).select("claim_id", "kind")


@query("numeric_diff", """SELECT n.o_orderkey AS id, n.p AS now, o.p AS was FROM (SELECT o_orderkey, (o_orderkey * 37 % 1001)::DOUBLE / 10 AS p FROM orders) o JOIN (SELECT o_orderkey, (o_orderkey * 37 % 1001)::DOUBLE / 10 + CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 3 = 1 THEN 0.25 ELSE 0 END AS p FROM orders) n USING (o_orderkey) WHERE abs(n.p - o.p) > 0.5""")
def _(t):
    base = (F.col("o_orderkey") * 37 % 1001).cast("double") / 10
    old = t.orders.select(F.col("o_orderkey").alias("id"), base.alias("p"))
    new = t.orders.select(F.col("o_orderkey").alias("id"), (base + F.when(F.col("o_orderkey") % 3 == 0, 2.0).when(F.col("o_orderkey") % 3 == 1, 0.25).otherwise(0.0)).alias("p"))
    moved = C.snapshot_compare(old, new, ["id"], ["p"], {"p": 0.5}).select("id")
    return moved.join(new.withColumnRenamed("p", "now"), "id").join(old.withColumnRenamed("p", "was"), "id")


@query("only_old_claims", "SELECT claim_id, gene FROM fx_claims_old WHERE claim_id NOT IN (SELECT claim_id FROM fx_claims_new)")
def _(t):
    return t.fx_claims_old.join(t.fx_claims_new, "claim_id", "left_anti").select("claim_id", "gene")


@query("gene_universe", "SELECT gene FROM fx_claims_old UNION SELECT gene FROM fx_claims_new UNION SELECT gene FROM fx_exons")
def _(t):
    return t.fx_claims_old.select("gene").union(t.fx_claims_new.select("gene")).union(t.fx_exons.select("gene")).distinct()


RULES = {
    "claims.unique": (("claims",), "SELECT claim_id AS key FROM {claims} GROUP BY claim_id HAVING count(*) > 1"),
    "claims.stars_known": (("claims",), "SELECT claim_id AS key FROM {claims} WHERE stars IS NULL"),
    "claims.limited_low_stars": (("claims",), "SELECT claim_id AS key FROM {claims} WHERE overall = 'Strong' AND stars = 0"),
    "claims.statement": (("claims",), "SELECT claim_id AS key FROM {claims} WHERE statement IS NULL OR statement = ''"),
    "scores.percentile_range": (("scores",), "SELECT pgs_id AS key FROM {scores} WHERE percentile < 0 OR percentile > 100"),
    "scores.scored_if_passed": (("scores",), "SELECT pgs_id AS key FROM {scores} WHERE passed AND percentile IS NULL"),
    "scores.featured_scored": (("scores",), "SELECT pgs_id AS key FROM {scores} WHERE featured AND NOT passed"),
    "sites.reads_positive": (("sites",), "SELECT CAST(site_id AS STRING) AS key FROM {sites} WHERE ref_reads < 0 OR alt_reads < 0"),
    "sites.expected_copies": (("sites",), "SELECT CAST(site_id AS STRING) AS key FROM {sites} WHERE expected NOT BETWEEN 0 AND 2"),
    "variants.het_has_alt": (("variants",), "SELECT CAST(pos AS STRING) AS key FROM {variants} WHERE gt = '0/1' AND ref = alt"),
    "repeats.readable": (("repeats",), "SELECT 'x' AS key FROM {repeats}"),
}


def _check_sql() -> str:
    names = {"claims": "fx_claims_new", "scores": "fx_scores", "sites": "fx_sites", "variants": "fx_variants"}
    parts = []
    for rule, (needs, sql) in RULES.items():
        if needs[0] in names:
            bad = sql.format(**{n: names[n] for n in needs})
            parts.append(f"SELECT '{rule}' AS rule, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status, count(*) AS violations, coalesce(list_sort(list(key))[1:10], []) AS examples FROM ({bad})")
        else:
            parts.append(f"SELECT '{rule}', 'skipped', 0, []::VARCHAR[]")
    return " UNION ALL ".join(parts)


@query("release_checks", _check_sql())
def _(t):
    tables = {"claims": t.fx_claims_new, "scores": t.fx_scores, "sites": t.fx_sites, "variants": t.fx_variants}
    return C.run_checks(tables, RULES, t.spark)


_DIGESTED = {"claims": "fx_claims_new", "scores": "fx_scores", "sites": "fx_sites", "variants": "fx_variants"}


def _digest_sql() -> str:
    """Columns in the order of their names as text, nulls as a mark, and a sum over 40 bits of the rows' md5."""
    from ..fixtures import columns_of

    rows = lambda cols: " || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in sorted(cols))
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n_rows, coalesce(sum(('0x' || left(md5({rows(columns_of(fx))}), 10))::BIGINT), 0)::BIGINT AS digest FROM {fx}" for name, fx in _DIGESTED.items())


@query("release_digest", _digest_sql())
def _(t):
    out = None
    for name, fx in _DIGESTED.items():
        row = C.digest(getattr(t, fx)).select(F.lit(name).alias("table_name"), "n_rows", "digest")
        out = row if out is None else out.unionByName(row)
    return out


@query("forbidden_scan", "SELECT doc_id FROM documents WHERE contains(coalesce(text, ''), 'AKIA') OR contains(coalesce(text, ''), 'token = ') OR contains(coalesce(source, ''), 'AKIA') OR contains(coalesce(source, ''), 'token = ') OR contains(coalesce(lang, ''), 'AKIA')")
def _(t):
    d = t.documents
    return d.filter(C.contains_any(d, ["AKIA", "token = "])).select("doc_id")


@query("strip_markup", r"""SELECT page_id, length(s) AS n, md5(s) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS s FROM pages)""")
def _(t):
    from ..functions.text import strip_markup

    s = t.pages.select("page_id", strip_markup(F.col("html")).alias("s"))
    return s.select("page_id", F.length("s").alias("n"), F.md5("s").alias("digest"))


@query("quote_numbers", r"""WITH p AS (SELECT page_id AS id, list_distinct(regexp_extract_all(replace(coalesce(html, ''), ',', ''), '[0-9]+')) AS have FROM pages), d AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(replace(coalesce(text, ''), ',', ''), '[0-9]+')) AS want FROM documents)
 SELECT id, list_sort(list_filter(want, lambda x: NOT list_contains(have, x))) AS missing FROM d JOIN p USING (id)""")
def _(t):
    from ..functions.text import numbers

    have = t.pages.select(F.col("page_id").alias("id"), numbers(F.col("html")).alias("have"))
    want = t.documents.select(F.col("doc_id").alias("id"), numbers(F.col("text")).alias("want"))
    return want.join(have, "id").select("id", F.array_sort(F.array_except("want", "have")).alias("missing"))


@query("genotype_leak_scan", r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[0-9]+/[0-9]+')) AS genotype_like, length(coalesce(text, '')) > 50000 AS oversized FROM documents""")
def _(t):
    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.regexp_count(text, F.lit("[0-9]+/[0-9]+")).alias("genotype_like"), (F.length(text) > 50_000).alias("oversized"))


# The sixty letters and digits are the rule for titles; a text without any has no title and matches nothing. The titles of the
# second table are lines of the documents, so that some match.
_TITLE = "left(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]', '', 'g'), 60)"


@query("title_match", f"""WITH a AS (SELECT doc_id, {_TITLE.format('text')} AS k FROM documents), b AS (SELECT item_id, {_TITLE.format('text')} AS k FROM benchmark UNION ALL SELECT -doc_id - 1, {_TITLE.format("'(*) ' || text")} FROM documents WHERE doc_id % 2 = 0)
 SELECT doc_id, item_id FROM a JOIN b USING (k) WHERE k <> ''""")
def _(t):
    from ..functions.text import norm_title

    a = t.documents.select("doc_id", norm_title(F.col("text")).alias("k"))
    again = t.documents.filter("doc_id % 2 = 0").select((-F.col("doc_id") - 1).alias("item_id"), norm_title(F.concat(F.lit("(*) "), "text")).alias("k"))
    b = t.benchmark.select("item_id", norm_title(F.col("text")).alias("k")).unionByName(again)
    return a.filter("k <> ''").join(b, "k").select("doc_id", "item_id")


@query("url_kinds", r"""SELECT page_id, CASE WHEN url IS NULL THEN NULL WHEN regexp_matches(url, '^https?://[^/?#]+/?$') THEN 'home' WHEN regexp_matches(url, '/[0-9]+') THEN 'record' ELSE 'other' END AS kind FROM pages""")
def _(t):
    u = F.col("url")
    return t.pages.select("page_id", F.when(u.rlike("^https?://[^/?#]+/?$"), "home").when(u.rlike("/[0-9]+"), "record").when(u.isNotNull(), "other").alias("kind"))
