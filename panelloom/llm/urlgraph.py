"""URL filtering by rules and by trust that spreads over links between hosts.

Rules name a host and a path prefix; the longest rule that fits decides a page. For the
other pages their host decides: the share of a host's pages that rules allow seeds trust,
the share that rules block seeds distrust. Trust follows links as personalised PageRank,
distrust follows them backwards, to the hosts that link to what is blocked. Scores move
until all that could still move, over all hosts, is below TOLERANCE. A host is
blocked if its distrust exceeds its trust by the threshold, half of what a wholly blocked
host has by itself. Links are counted per pair of hosts before they move, so a host with
very many pages is one node; links within a host and links without a host count for nothing,
and so do relative links, whatever their paths and queries hold. Seeds are as large as their
shares, not scaled to sum to one, so that a verdict doesn't depend on how many other hosts
there are; what a host without links would pass on ends there.

Defined cases: a null url, or one without ://, has an empty host and path, fits no rule
and is allowed, there being no evidence; null html has no links; repeated rows are judged
alike and counted each, and so are rows with a null id; an empty table gives an empty
result; columns named like a result are replaced by it, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, small, table

#: (verdict, host and path prefix).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, THRESHOLD, CUT_EVERY = 0.85, 0.5, 3
#: What rounds may leave unmoved, and the rounds after which that is an error.
TOLERANCE, MOST_ROUNDS = 1e-6, 300
#: What SQL no longer passes on from a host; it goes on until no host has more.
LEAST_MOVED = 1e-10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ABSOLUTE = "^[A-Za-z][A-Za-z0-9+.-]*://"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?([^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rules(hosts: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """(host, rules): the rules that fit a host or a domain above it, longest first."""
    rule = [F.struct(F.lit(r.split("/", 1)[0]).alias("domain"), F.lit("/" + r.split("/", 1)[1]).alias("prefix"), F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(v).alias("says")) for v, r in rules]
    named = hosts.sparkSession.range(1).select(F.inline(F.array(*rule)))
    above = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    fits = hosts.select("host", F.explode(above).alias("domain")).join(F.broadcast(named), "domain")  # the rules are a literal list
    return fits.groupBy("host").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "rule", "prefix", "says")))).alias("rules"))


def links(pages: DataFrame) -> DataFrame:
    """(source, target, n): links between different hosts."""
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).when(F.col("link").rlike(ABSOLUTE), F.col("link"))
    target, _ = host_and_path(whole)
    found = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    found = found.select(F.col("host").alias("source"), target.alias("target"))
    return found.filter((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))).groupBy("source", "target").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING, stash: Stash | None = None) -> DataFrame:
    """(host, kind, score) from seeds (host, kind, seed), kind trust along edges and distrust against them."""
    stash = stash or Stash(seeds.sparkSession, "hosts")
    out = edges.groupBy("source").agg(F.sum("n").alias("all")).withColumnRenamed("source", "of")
    into = edges.groupBy("target").agg(F.sum("n").alias("all")).withColumnRenamed("target", "of")
    steps = stash.put(
        edges.join(out, edges["source"] == out["of"]).select(F.col("source").alias("from"), F.col("target").alias("to"), F.lit("trust").alias("way"), (F.col("n") / F.col("all")).alias("share"))
        .unionAll(edges.join(into, edges["target"] == into["of"]).select(F.col("target").alias("from"), F.col("source").alias("to"), F.lit("distrust").alias("way"), (F.col("n") / F.col("all")).alias("share")))
    )
    start = seeds.select("host", "kind", ((1 - damping) * F.col("seed")).alias("score"))
    if steps.isEmpty():
        return start
    # moved is what the last round brought; a round passes on its damping at most, so all later ones bring damping / (1 - damping) times it.
    held = scores = stash.put(start.withColumn("moved", F.col("score")))
    for k in range(1, MOST_ROUNDS + 1):
        moved = scores.filter("moved > 0").join(steps, (F.col("host") == F.col("from")) & (F.col("kind") == F.col("way")))
        moved = moved.select(F.col("to").alias("host"), "kind", (damping * F.col("moved") * F.col("share")).alias("moved"))
        rows = scores.select("host", "kind", "score", F.lit(0.0).alias("moved")).unionAll(moved.select("host", "kind", F.col("moved").alias("score"), "moved"))
        scores = rows.groupBy("host", "kind").agg(F.sum("score").alias("score"), F.sum("moved").alias("moved"))
        if k % CUT_EVERY == 0:
            scores = stash.put(scores)
            stash.drop(held)
            held = scores
            if (scores.agg(F.sum("moved")).first()[0] or 0.0) * damping / (1 - damping) < tolerance:
                return scores.drop("moved")
    raise RuntimeError(f"scores of hosts don't settle in {MOST_ROUNDS} rounds")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """pages without html, plus host, path, rule, verdict, trust and distrust."""
    stash = Stash(pages.sparkSession, "hosts")
    host, path = host_and_path(F.col("url"))
    pages = pages.drop("host", "path", "rule", "verdict", "trust", "distrust").withColumns({"host": host, "path": path})
    bare = pages.drop("html")
    fitting = host_rules(bare.filter(F.col("host") != "").select("host").distinct(), rules).withColumnRenamed("host", "_host")
    fitting = small(stash.put(fitting))
    ruled = bare.join(fitting, F.col("host") == F.col("_host"), "left").drop("_host")
    ruled = ruled.withColumn("_rule", F.expr("get(filter(rules, r -> startswith(path, r.prefix)), 0)")).drop("rules")
    ruled = ruled.withColumns({"rule": F.col("_rule.rule"), "_says": F.col("_rule.says")}).drop("_rule")
    shares = ruled.filter(F.col("host") != "").groupBy("host").agg(*[F.avg((F.coalesce(F.col("_says"), F.lit("")) == says).cast("double")).alias(kind) for says, kind in (("allow", "trust"), ("block", "distrust"))])
    seeds = shares.selectExpr("host", "stack(2, 'trust', trust, 'distrust', distrust) as (kind, seed)").filter("seed > 0")
    scores = spread(seeds, stash.put(links(pages)), stash=stash)
    per = scores.groupBy(F.col("host").alias("_host")).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    per = small(stash.put(per))
    out = ruled.join(per, F.col("host") == F.col("_host"), "left").drop("_host")
    own = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) >= threshold * (1 - DAMPING), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce("_says", own)).drop("_says")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    cut = lambda x: f"coalesce(CASE WHEN instr({x}, '://') > 0 THEN substr({x}, instr({x}, '://') + 3) ELSE '' END, '')"
    host = lambda x: f"translate(regexp_extract({x}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
    rules = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', {len(r)}, '{r}', '{v}')" for v, r in RULES)
    link = LINK.replace("'", "''")
    return f"""
WITH RECURSIVE rest AS (
  SELECT row_number() OVER () AS rid, page_id, html, {cut("url")} AS rest FROM pages
), p AS (
  SELECT rid, page_id, html, {host("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(domain, prefix, size, rule, says) AS (VALUES {rules}), best AS (
  SELECT rid, max_by(rule, size) AS rule, max_by(says, size) AS says FROM p JOIN rules ON (host = domain OR host LIKE '%.' || domain) AND starts_with(path, prefix) GROUP BY rid
), ruled AS (
  SELECT p.rid, page_id, host, path, rule, says FROM p LEFT JOIN best ON p.rid = best.rid
), shares AS (
  SELECT host, avg(CASE WHEN says = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN says = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM ruled WHERE host <> '' GROUP BY host
), link AS (
  SELECT host, CASE WHEN starts_with(l, '//') THEN 'http:' || l WHEN regexp_matches(l, '{ABSOLUTE}') THEN l END AS l FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS l FROM p)
), pair AS (
  SELECT host AS source, {host("(" + cut("l") + ")")} AS target FROM link
), edges AS (
  SELECT source, target, count(*) AS n FROM pair WHERE source <> '' AND target <> '' AND source <> target GROUP BY source, target
), steps AS MATERIALIZED (
  SELECT source AS from_host, target AS to_host, 'trust' AS kind, n / sum(n) OVER (PARTITION BY source) AS share FROM edges UNION ALL
  SELECT target, source, 'distrust', n / sum(n) OVER (PARTITION BY target) FROM edges
), moved(host, kind, score) AS (
  (SELECT host, 'trust', {1 - DAMPING} * trust FROM shares WHERE trust > 0 UNION ALL SELECT host, 'distrust', {1 - DAMPING} * distrust FROM shares WHERE distrust > 0)
  UNION ALL
  SELECT e.to_host, e.kind, sum({DAMPING} * m.score * e.share) FROM moved m JOIN steps e ON m.host = e.from_host AND m.kind = e.kind
  GROUP BY e.to_host, e.kind HAVING sum({DAMPING} * m.score * e.share) > {LEAST_MOVED:.10f}
), per AS (
  SELECT host, sum(CASE WHEN kind = 'distrust' THEN score ELSE -score END) AS excess FROM moved GROUP BY host
)
SELECT page_id, ruled.host, path, rule, coalesce(says, CASE WHEN coalesce(excess, 0) >= {THRESHOLD * (1 - DAMPING)} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN per ON ruled.host = per.host
"""


SQL = _sql()
