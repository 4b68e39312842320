"""URL filters: rules found through their rarest literal token, and only those checked by regular expression.

Every rule is a regular expression over host + path with the literal tokens that any match must hold. The index files a rule under the
token that is rarest among all URLs, so a common token such as a top-level domain fetches few rules. A URL's own tokens fetch candidates by an
equi-join; only candidates run their expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path): the host and its subdomains, paths that start so; the longest that fits decides.
SITE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words that mark advertising or tracking hosts and folders; a URL that no site rule fits is blocked if one stands there as a whole token.
AD_WORDS = ("ads", "adserver", "doubleclick", "track", "tracker", "tracking", "sponsored", "clickbait", "popunder", "affiliate")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if t]


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and a path prefix. A prefix that breaks off inside a token gives that token no part in the index."""
    literal = host + path
    found = tokens_of(literal)
    if path and re.search("[A-Za-z0-9]$", path):
        found.pop()
    return Rule(literal, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path) or '(?:/|$)'}", tuple(found), 1_000 + len(literal))


def parsed_rule(line: str) -> Rule:
    """A rule of host + path in the syntax of block lists, letter case of A-Z aside: * stands for anything, ^ for a separator or the end, || for the beginning of a host or subdomain, | for either end, @@ before all for an exception."""
    verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
    start = re.match(r"\|{0,2}", body)[0]
    body, end = body[len(start) :], body.endswith("|")
    body = body[:-1] if end else body
    separator = "(?:[^A-Za-z0-9_.%-]|$)"
    pattern = "".join(".*" if c == "*" else separator if c == "^" else re.escape(c) for c in body)
    head = {"": "", "|": "^", "||": r"^(?:[^/]*\.)?"}[start]
    # A token at an open end may go on in the URL, so it has no part in the index.
    inner = re.split(r"[*]", body)
    found = []
    for k, piece in enumerate(inner):
        runs = [(m[0], m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]+", piece)]
        for token, at, to in runs:
            opens = at == 0 and not (k == 0 and start)
            closes = to == len(piece) and not (k == len(inner) - 1 and end)
            if not opens and not closes:
                found += tokens_of(token)
    return Rule(line, verdict, f"(?is){head}{pattern}{'$' if end else ''}", tuple(found), 500 if verdict == "allow" else 0)


def word_rule(word: str) -> Rule:
    return Rule(f"*{word}*", "block", rf"(?i)(?:^|[^a-z0-9]){re.escape(word)}(?:[^a-z0-9]|$)", (word,), 0)


def default_rules() -> list[Rule]:
    return [site_rule(*r) for r in SITE_RULES] + [word_rule(w) for w in AD_WORDS]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and matched_rule of every row of pages (page_id, url).

    The site rule of the longest host and path that fits gives rule and verdict. Where none fits, rule is null and the other
    rules decide: an exception before a block (matched_rule names the first of those that fit), else allow. A null url, or one without ://, has an empty host and path and is allowed
    unless a rule without tokens fits. Repeated rows each get their verdict; other columns are ignored; an empty table gives an empty result. Letter case is
    folded for A-Z alone. The rules are a list held by the driver, so the joined index is bounded by it.
    """
    spark = pages.sparkSession
    rules = default_rules() if rules is None else rules
    # row keeps a page's own tokens together: each page is one group of its own, so a URL of many pages is no hot key.
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row"))
    target = F.concat("host", "path")
    folded = F.translate(target, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    token = F.explode(F.array_union(F.array_distinct(F.split(folded, "[^a-z0-9]+")), F.array(F.lit("")))).alias("token")
    indexable = sorted({t for r in rules for t in r.tokens})
    known = F.broadcast(spark.createDataFrame([(t,) for t in indexable], "token string"))
    counts = {r["token"]: r["n"] for r in split.select(token).join(known, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}
    index = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else "", r.name, r.verdict, r.pattern, r.rank) for r in rules]
    index = F.broadcast(spark.createDataFrame(index, "token string, name string, says string, pattern string, rank int"))
    # Every page has the token "", so it stays in the left join; candidates alone run their expressions.
    met = split.select("*", target.alias("target"), token).join(index, "token", "left")
    fits = F.when(F.col("pattern").isNotNull() & F.rlike("target", F.col("pattern")), F.struct("rank", "name", "says"))
    judged = met.groupBy("row", "page_id", "host", "path").agg(F.max(fits).alias("best"))
    site = F.col("best.rank") >= 1_000
    return judged.select(
        "page_id", "host", "path", F.when(site, F.col("best.name")).alias("rule"), F.coalesce("best.says", F.lit("allow")).alias("verdict"),
        F.when(~site, F.col("best.name")).alias("matched_rule"),
    )


def op3_url_filters(spark, sf_dir):
    """Every page's URL with its verdict."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    host = "translate(regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1)"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in SITE_RULES)
    words = "|".join(AD_WORDS)
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS k, page_id, {host} AS host, {path} AS path FROM pages),
m AS (SELECT k, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM p, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN verdict
            WHEN regexp_matches(host || path, '(?i)(^|[^a-z0-9])({words})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN m USING (k)"""


ORACLE_SQL = _oracle()
