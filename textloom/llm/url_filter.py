"""URL filters: rules for hosts and paths, and trust that spreads over the links between hosts.

A rule is a host and the start of a path; it fits the host, its subdomains and urls whose path starts so; the longest
rule decides. Hosts without a fitting rule are judged by two personalised PageRanks over the host graph (edges are the
links of pages to other hosts, added up before they are shuffled): trust starts at hosts with allowed pages and follows links;
distrust starts at hosts with blocked pages and follows them backwards. A seed's mass is the share of its pages that the
rules allow or block, so the scores do not depend on the number of hosts. A host is judged by what it receives over links: its
own seed speaks for the pages that a rule fits, and these have their verdict. Distrust is divided among all who link to a host,
so whether there is enough of it is asked of another score, exposure: the damped share of the host's own links that
lead to blocked pages, at once or over other hosts. A host is blocked if its exposure reaches the threshold and the distrust that
it receives exceeds the trust.

Defined results: a null url or one without ``://`` has an empty host and path and is allowed; null html has no links;
repeated rows are judged alike; an empty table gives an empty result; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_ROWS, HOT_ROWS, hot_join, small, written

#: (rule, verdict); production rules of op8
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-3, 0.05
#: Links of the longest paths that the SQL adds up.
SQL_ROUNDS = 60
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What holds no links: comments, scripts and styles, to the end of the page if they aren't closed.
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
#: A link's address, with its quotes.
_HREF = r"""(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to /, ?, # or the end, with A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; else null. The rules are literals of the plan: some hundreds at most."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/") if "/" in rule else len(rule)
        own, start = rule[:at], rule[at:]
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links from pages of one host to another."""
    read = F.regexp_replace(F.col(html_col), _UNREAD, " ")
    links = F.transform(F.regexp_extract_all(read, F.lit(_HREF), 1), lambda x: F.btrim(x, F.lit("\"' \t\r\n")))
    full = F.transform(links, lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))
    full = F.filter(full, lambda x: x.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"))
    rows = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(full).alias("link")).withColumn("dst", host_of(F.col("link")))
    return rows.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, iterations: int | None = None, tolerance: float = TOLERANCE, per: str = "src") -> DataFrame:
    """(host, score) with score = seed + damping * sum over links of the linking host's score, in proportion to its links
    (``per`` src: a host divides what it has) or to those of the host that they lead to (dst: a host takes the mean).

    edges(src, dst, n) and seeds(host, seed). Each round joins scores with edges and adds up per host; its table is
    written to the shared folder. Ends when what changes is less than ``tolerance``: in all hosts together if they divide,
    in any of them if they take means. Either shrinks by ``damping`` a round at least, so the rounds are about the logarithm of the seeds' sum, and then
    what all hosts lack together (any of them, if they take means) is at most tolerance * damping / (1 - damping). ``iterations``, if given, ends it sooner."""
    sums = [F.sum("n").alias("all"), F.count(F.lit(1)).alias("links")]
    with_all = hot_join(edges, written(edges.groupBy(per).agg(*sums), "sums"), per, "links", F.xxhash64("src", "dst"))
    # the links of a hub lie in several tasks, to each of which its score is copied
    degree = written(edges.groupBy("src").agg(F.count(F.lit(1)).alias("links")).where(F.col("links") > HOT_ROWS).select("src", F.ceil(F.col("links") / F.lit(float(HOT_ROWS))).cast("int").alias("salts")), "hubs")
    hubs = small(degree, degree.count())
    salt = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("salts").cast("long")).cast("int"), F.lit(0)).alias("salt")
    share = written(with_all.join(hubs, "src", "left").select("src", salt, "dst", (F.col("n") / F.col("all")).alias("share")), "edges")
    scores, most = seeds.select("host", F.col("seed").alias("score")), F.sum if per == "src" else F.max
    if seeds.isEmpty() or share.isEmpty():
        return scores
    for i in count(1):
        dealt = scores.withColumnRenamed("host", "src").join(hubs, "src", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        sent = dealt.join(share, ["src", "salt"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("share") * damping).alias("got"))
        new = seeds.join(sent, seeds["host"] == sent["dst"], "full_outer").select(F.coalesce("host", "dst").alias("host"), (F.coalesce("seed", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("score"))
        new = written(new, "scores")
        old = scores.select("host", F.col("score").alias("old"))
        change = new.join(old, "host", "full_outer").agg(most(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        scores = new
        if change < tolerance or i == iterations:
            return scores


def judge(pages: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the trust and distrust that its host receives."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.coalesce(F.col("fits.verdict") == v, F.lit(False)).cast("double"))
    by_host = written(rows.groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")).where("good > 0 or bad > 0"), "seeds")
    edges = written(host_edges(pages, url_col=url_col, html_col=html_col), "links")
    trust = propagate(edges, by_host.where("good > 0").select("host", F.col("good").alias("seed")), **options)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    blocked = by_host.where("bad > 0").select("host", F.col("bad").alias("seed"))
    distrust, exposure = propagate(back, blocked, **options), propagate(back, blocked, per="dst", **options)
    scores = trust.select("host", F.col("score").alias("trust")).join(distrust.select("host", F.col("score").alias("distrust")), "host", "full_outer")
    scores = scores.join(exposure.select("host", F.col("score").alias("exposure")), "host", "full_outer").join(by_host, "host", "left").na.fill(0.0)
    received = [(F.col(score) - F.col(seed)).alias(score) for score, seed in (("trust", "good"), ("distrust", "bad"), ("exposure", "bad"))]
    scores = written(scores.select("host", *received), "verdicts")
    n = scores.count()
    if n <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(scores), "host", "left")
    else:
        sized = written(scores.join(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "host"), "verdicts")
        out = hot_join(rows, sized, "host", "pages", F.xxhash64("page_id", "path"), how="left")
    out = out.na.fill(0.0, ["trust", "distrust", "exposure"])
    by_method = F.when((F.col("exposure") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", by_method).alias("verdict"), "trust", "distrust")


def oracle_sql(rules: Sequence[tuple[str, str]] = RULES, damping: float = DAMPING, threshold: float = THRESHOLD, rounds: int = SQL_ROUNDS) -> str:
    """The verdicts in DuckDB's SQL: what a host receives is the sum, over paths of 1 to ``rounds`` links, of damped shares."""
    host = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(r)}, {quoted(r[: r.index('/')] if '/' in r else r)}, {quoted(r[r.index('/') :] if '/' in r else '')}, {quoted(v)})" for r, v in rules)
    found = f"list_transform(regexp_extract_all(regexp_replace(html, {quoted(_UNREAD)}, ' ', 'g'), {quoted(_HREF)}, 1), lambda x: trim(x, '\"'' ' || chr(9) || chr(13) || chr(10)))"
    walks = ", ".join(
        f"""{name}_walk(k, host, x) AS (
  SELECT 0, host, {seed}::DOUBLE FROM seeds WHERE {seed} > 0
  UNION ALL SELECT k + 1, e.dst, sum(x * e.share * {damping}::DOUBLE) FROM {name}_walk w JOIN {edges} e ON e.src = w.host WHERE k < {rounds} GROUP BY k, e.dst
), {name} AS (SELECT host, sum(x) AS {name} FROM {name}_walk WHERE k > 0 GROUP BY host)"""
        for name, seed, edges in (("trust", "good", "onward"), ("distrust", "bad", "backward"), ("exposure", "bad", "means"))
    )
    return f"""
WITH RECURSIVE rule(rule, own, start, verdict) AS (VALUES {table}),
parts AS (
  SELECT page_id, html, coalesce({host.format("url")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), numbered AS (SELECT *, row_number() OVER () AS row FROM parts
), fits AS (
  SELECT row, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM numbered JOIN rule ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY row
), judged AS (SELECT n.*, f.rule, f.verdict FROM numbered n LEFT JOIN fits f USING (row)
), seeds AS (
  SELECT host, avg(coalesce(verdict = 'allow', false)::INT) AS good, avg(coalesce(verdict = 'block', false)::INT) AS bad FROM judged GROUP BY host
), links AS (
  SELECT host AS src, unnest({found}) AS link FROM parts
), edges AS (
  SELECT src, dst, count(*) AS n FROM (SELECT src, {host.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM links WHERE regexp_matches(CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END, '^[A-Za-z][A-Za-z0-9+.-]*://'))
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst
), onward AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges
), backward AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM edges
), means AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges
), {walks}
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(exposure, 0) >= {threshold}::DOUBLE AND coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN trust USING (host) LEFT JOIN distrust USING (host) LEFT JOIN exposure USING (host)
"""
