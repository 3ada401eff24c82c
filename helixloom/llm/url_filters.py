"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host || path`` with literal tokens that every matching URL must hold. Tokens of
all URLs are counted once; each rule is filed under the token that the fewest URLs hold. A URL's tokens fetch its
candidate rules from that index, and only those run their regular expressions. Up to LITERAL_RULES rules, the index is a
constant of the plan and nothing is shuffled but the token counts; a longer list is a table that the tokens of the URLs are
joined to, and the best rule of each URL is an aggregation.

Defined results: of rules that fit, the largest (rank, name) wins; a null URL, or one without ``://``, has an empty host and path, no rule, and the default verdict;
repeated rows are judged one by one; very long URLs are judged whole; an empty table gives an empty result; other columns
stay, whatever their names, and one already named like the output is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, put_back, set_aside, text_of, written

LITERAL_RULES = 2_000
BUCKETS = 64
TOKEN_RE = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """name: what is reported; verdict: allow or block; pattern: Java regular expression over host || path;
    tokens: lower-case literals, each of them a whole token of any URL that matches; rank: larger wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def host_path_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and a path prefix; the longest wins."""
    whole = re.findall(r"[a-z0-9]+(?=[^a-zA-Z0-9])", path.lower()) if path.isascii() else []
    safe = [t for t in whole if t in re.split("[^a-zA-Z0-9]+", path)]
    tokens = tuple(dict.fromkeys([t for t in re.split("[^a-z0-9]+", host.lower()) if t] + safe))
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?\Q{host.lower()}\E\Q{path}\E", tokens, 1_000_000 + len(host + path))


def keyword_rule(verdict: str, word: str, pattern: str) -> Rule:
    """A rule of the method's own list, which decides only where no host rule does."""
    return Rule(f"~{word}", verdict, pattern, (word,), len(word))


#: The rules of the query, as (verdict, host, path).
HOST_RULES = [
    host_path_rule("block", "com", "/en/"),
    host_path_rule("allow", "example.com", "/en/7"),
    host_path_rule("allow", "net", "/de/"),
    host_path_rule("block", "example.net", "/de/8"),
    host_path_rule("block", "org", "/es/"),
]
#: Words of hosts and paths that mark advertising, spam and logins.
KEYWORD_RULES = [
    keyword_rule("block", w, rf"(?:^|[^a-zA-Z0-9])(?i:{w})(?:$|[^a-zA-Z0-9])")
    for w in ("spam", "casino", "porn", "xxx", "viagra", "adserver", "doubleclick", "tracker", "popup", "clickbait", "login", "signin", "logout", "cart", "checkout", "torrent", "warez", "phishing", "malware")
]
#: Patterns of several words, as (name, tokens, pattern).
PATTERN_RULES = [
    Rule(f"~{name}", "block", rf"(?i)(?:^|[^a-zA-Z0-9]){pattern}(?:$|[^a-zA-Z0-9])", tokens, 100 + len(pattern))
    for name, tokens, pattern in (
        ("ad-banner", ("ad", "banner"), "ad[^a-zA-Z0-9].*banner"),
        ("affiliate-link", ("affiliate", "id"), "affiliate[/_-]+id"),
        ("free-download", ("free", "download", "crack"), "free[/_-]+download.*crack"),
        ("online-poker", ("online", "poker"), "online[/_-]+poker"),
        ("payday-loan", ("payday", "loan"), "payday[/_-]+loan"),
        ("print-view", ("print", "view"), "(?:print[/_-]+view|view[/_-]+print)"),
        ("user-register", ("user", "register"), "user/(?:[^/]*/)?register"),
        ("wp-admin", ("wp", "admin"), "wp-admin"),
    )
]
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.expr("substr(_u_url, instr(_u_url, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.expr("substr(_u_url, instr(_u_url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def _parts(df: DataFrame, url: str) -> DataFrame:
    df = df.withColumn("_u_url", text_of(F.col(f"`{url}`")))
    df = df.withColumn("_u_host", host_of(F.col("_u_url"))).withColumn("_u_path", path_of(F.col("_u_url")))
    key = F.concat("_u_host", "_u_path")
    tokens = F.array_distinct(F.array_remove(F.split(F.translate(key, UPPER, UPPER.lower()), TOKEN_RE), ""))
    return df.withColumn("_u_key", key).withColumn("_u_tokens", tokens)


def token_counts(df: DataFrame, rules: list[Rule], url: str = "url") -> dict[str, int]:
    """In how many URLs each token of the rules stands; as many rows as the rules have tokens at most."""
    wanted = sorted({t for r in rules for t in r.tokens})
    found = _parts(df.select(F.col(f"`{url}`")), url).select(F.explode(F.filter("_u_tokens", lambda t: t.isin(wanted))).alias("token"))
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}


def rule_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        if not rule.tokens:
            raise ValueError(f"rule {rule.name} has no literal token to index it by")
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    return index


def _literal_index(index: dict[str, list[Rule]]) -> Column:
    """One map of token to rules for each hash bucket of tokens, so that a look-up scans a few entries."""
    import zlib

    packed = lambda r: F.struct(F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
    maps = []
    for b in range(BUCKETS):
        own = {t: rs for t, rs in sorted(index.items()) if zlib.crc32(t.encode()) % BUCKETS == b}
        if own:
            maps.append(F.create_map(*[x for t, rs in own.items() for x in (F.lit(t), F.array(*[packed(r) for r in rs]))]))
        else:
            maps.append(F.lit(None).cast("map<string,array<struct<rank:int,name:string,verdict:string,pattern:string>>>"))
    return F.array(*maps)


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = DEFAULT_VERDICT, out: str = "judged") -> DataFrame:
    """df with column `out`: struct(host, path, rule, verdict, n_candidates); `rule` is the name of the rule that won."""
    df, named = set_aside(df, "_u_")
    url, keep = named[url], [c for c in df.columns if c != out]
    found = rule_index(rules, token_counts(df, rules, url))
    work = _parts(df.select(*[F.col(f"`{c}`") for c in keep]), url)
    if len(rules) > LITERAL_RULES:
        work = _joined(work, found)
    else:
        index = _literal_index(found)
        fetch = lambda t: F.coalesce(F.try_element_at(F.get(index, F.pmod(F.crc32(t.cast("binary")), F.lit(BUCKETS)).cast("int")), t), F.array().cast("array<struct<rank:int,name:string,verdict:string,pattern:string>>"))
        work = work.withColumn("_u_cand", F.flatten(F.transform("_u_tokens", fetch)))
        best = F.array_max(F.transform(F.filter("_u_cand", lambda r: F.regexp(F.col("_u_key"), r["pattern"])), lambda r: F.struct(r["rank"], r["name"], r["verdict"])))
        work = work.withColumn("_u_best", best).withColumn("_u_n", F.size("_u_cand"))
    done = work.select(
        *[F.col(f"`{c}`") for c in keep],
        F.struct(
            F.col("_u_host").alias("host"),
            F.col("_u_path").alias("path"),
            F.col("_u_best.name").alias("rule"),
            F.coalesce("_u_best.verdict", F.lit(default)).alias("verdict"),
            F.col("_u_n").alias("n_candidates"),
        ).alias(out),
    )
    return put_back(done, named)


def _joined(work: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    """work with _u_best and _u_n, from a table of (token, rule): rows are numbered, and only their tokens travel."""
    rows = [(t, r.rank, r.name, r.verdict, r.pattern) for t, rs in index.items() for r in rs]
    table = work.sparkSession.createDataFrame(rows, "_u_token string, rank int, name string, verdict string, pattern string")
    work = written(work.withColumn("_u_no", F.monotonically_increasing_id()), "urls")
    fetched = work.select("_u_no", "_u_key", F.explode("_u_tokens").alias("_u_token")).join(table, "_u_token")
    fits = F.when(F.regexp(F.col("_u_key"), F.col("pattern")), F.struct("rank", "name", "verdict"))
    best = fetched.groupBy("_u_no").agg(F.max(fits).alias("_u_best"), F.count("*").cast("int").alias("_u_n"))
    return work.join(best, "_u_no", "left").withColumn("_u_n", F.coalesce("_u_n", F.lit(0)))
