"""URL filters: listed rules, and link-graph propagation for what no rule decides.

Rules name a host (with its subdomains) and the beginning of a path; the
longest that fits decides.  Pages that rules allow or block make their hosts
trusted or blocked seeds.  Trust flows from the trusted along the links between
hosts, as personalised PageRank; distrust flows from the blocked against them,
to hosts that link there.  A host whose distrust outweighs its trust by the
threshold is blocked as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import drop, pick, stage, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The host of every link that names one.
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
#: (verdict, host, beginning of the path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
#: The part of all trust, or of all distrust, below which a host's own counts as none; what rounds still may change is less than its tenth.
FLOOR = 1e-9
#: The share of a host's trust and distrust that distrust must exceed.
BLOCK_OVER = 0.5


def _lowered(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one and for null."""
    return _lowered(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _URL, 2)


def _suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def rules_by_host(hosts: DataFrame, rules) -> DataFrame:
    """host, fitting: for each distinct host the rules on it and on domains above it; hosts without any are left out."""
    rows = hosts.sparkSession.createDataFrame([(v, _rule_host(h), p, h + p) for v, h, p in rules], "verdict string, domain string, prefix string, rule string")
    every = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("domain"))
    return every.join(rows, "domain").groupBy("host").agg(F.collect_list(F.struct("prefix", "verdict", "rule")).alias("fitting"))


def _rule_host(host: str) -> str:
    return host.translate(str.maketrans(_UPPER, _LOWER))


def longest(fitting: Column, path: Column) -> Column:
    """The longest rule whose path begins this one; of two as long, the first by text and then ``allow``."""
    fits = F.filter(fitting, lambda r: F.startswith(path, r["prefix"]))
    ranked = F.array_sort(F.transform(fits, lambda r: F.struct((-F.length(r["rule"])).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return F.get(ranked, F.lit(0))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, w: how many distinct links pages of one host hold to another host; links within a host are no edges."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(_LINK), 1))).alias("dst"))
    links = links.select("src", _lowered(F.col("dst")).alias("dst")).where("src <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def rounds_for(damping: float, floor: float) -> int:
    """After this many rounds all that scores can still change is under a tenth of ``floor``: each round leaves ``damping`` of the rest."""
    return math.ceil(math.log(floor / 20) / math.log(damping))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, floor: float = FLOOR) -> DataFrame:
    """host, score: personalised PageRank of ``seeds`` (host, seed) along ``edges`` (src, dst, w); scores sum to the seeds.

    A host passes ``damping`` of its score on, divided by weight.  The rest,
    and all that hosts without links hold, returns to the seeds.  Stops when
    what the scores may still change is less than a tenth of ``floor`` of their
    sum, and gives those of at least ``floor``.
    """
    out = edges.groupBy("src").agg(F.sum("w").alias("all"))
    steps = stage(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("all")).alias("part")), "link-steps")
    sources = stage(steps.select(F.col("src").alias("host")).distinct(), "link-sources")
    seeds = stage(seeds.where("seed > 0").select("host", F.col("seed").alias("score")), "link-seeds")
    mass = seeds.agg(F.sum("score")).first()[0] or 0.0  # one number
    scores, last = stage(seeds, "link-scores"), None
    for _ in range(rounds_for(damping, floor) if mass else 0):
        held = scores.join(sources, "host", "left_semi").agg(F.sum("score")).first()[0] or 0.0  # one number
        # Sums combine before the shuffle, so a host that all others link to gets one row from each task.
        sent = scores.join(steps, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (F.col("score") * F.col("part") * damping).alias("score"))
        back = seeds.select("host", (F.col("score") * F.lit(1 - damping * held / mass)).alias("score"))
        fresh = sent.unionByName(back).groupBy("host").agg(F.sum("score").alias("score"))
        last, scores = scores, stage(fresh, "link-scores")
        change = scores.unionByName(last.select("host", (-F.col("score")).alias("score"))).groupBy("host").agg(F.abs(F.sum("score")).alias("d")).agg(F.sum("d")).first()[0]
        drop(last)
        if (change or 0.0) <= (1 - damping) * floor / 10 * mass:
            break
    return scores.where(F.col("score") >= floor * mass)


def judge_urls(pages: DataFrame, rules=RULES, block_over: float = BLOCK_OVER, damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row for each row of ``pages`` (page_id, url, html).

    ``verdict`` is the longest fitting rule's, else ``block`` where the host's
    distrust is more than ``block_over`` of its trust and distrust together,
    else ``allow``; scores under FLOOR of all are none.  A host that no seed reaches is allowed.  A null url, or
    one without ``://``, has empty host and path, which no rule fits and no
    link reaches.  A null html has no links.  Rows that repeat are judged alike
    (and count as often as seeds); other columns are left out.
    """
    pages = pick(pages, "page_id", "url", "html")
    placed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = stage(placed.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    fitting = stage(rules_by_host(hosts, rules), "host-rules").withColumnRenamed("host", "_host")
    # One side has one row for each host; Spark splits a hot host's pages, or sends the hosts to all tasks while they are few.
    judged = placed.join(fitting, F.col("host") == F.col("_host"), "left").withColumn("best", longest(F.col("fitting"), F.col("path")))
    judged = judged.select("page_id", "host", "path", "best.rule", "best.verdict")
    counts = judged.groupBy("host").agg(*[F.count(F.when(F.col("verdict") == v, True)).cast("double").alias(v) for v in ("allow", "block")])
    counts = stage(counts, "host-seeds")
    edges = stage(host_edges(pages), "host-edges")
    trust = propagate(edges, counts.select("host", F.col("allow").alias("seed")), damping)
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = propagate(against, counts.select("host", F.col("block").alias("seed")), damping)
    scored = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    scored = scored.groupBy(F.col("host").alias("_host")).agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    out = judged.join(stage(scored, "host-scores"), F.col("host") == F.col("_host"), "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    method = F.when(distrust > block_over * (trust + distrust), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    listed = ", ".join(f"('{v}', '{_rule_host(h)}', '{p}')" for v, h, p in RULES)
    link = _LINK.replace("'", "''")
    return f"""
WITH RECURSIVE placed AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages
), rules(verdict, domain, prefix) AS (
  VALUES {listed}
), fitting AS (
  SELECT page_id, domain || prefix AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(domain || prefix) DESC, domain || prefix, verdict) AS nth
  FROM placed JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix)
), judged AS (
  SELECT p.page_id, host, path, rule, verdict FROM placed p LEFT JOIN fitting f ON p.page_id = f.page_id AND nth = 1
), seeds AS (
  SELECT verdict AS kind, host, count(*)::DOUBLE AS seed FROM judged WHERE verdict IS NOT NULL GROUP BY verdict, host
), masses AS (
  SELECT kind, sum(seed) AS mass FROM seeds GROUP BY kind
), links AS (
  SELECT host AS src, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '{link}', 1))) AS named FROM placed WHERE host <> ''
), edges AS (
  SELECT src, translate(named, '{_UPPER}', '{_LOWER}') AS dst, count(*)::DOUBLE AS w FROM links WHERE src <> translate(named, '{_UPPER}', '{_LOWER}') GROUP BY ALL
), steps AS (
  SELECT 'allow' AS kind, src, dst, w / sum(w) OVER (PARTITION BY src) AS part FROM edges
  UNION ALL
  SELECT 'block', dst, src, w / sum(w) OVER (PARTITION BY dst) FROM edges
), sources AS (
  SELECT DISTINCT kind, src FROM steps
), flow AS (
  SELECT 0 AS r, kind, host, seed AS score FROM seeds
  UNION ALL
  SELECT r + 1, kind, host, sum(score) FROM (
    SELECT f.r, f.kind, dst AS host, f.score * part * {DAMPING} AS score FROM flow f JOIN steps s ON f.kind = s.kind AND f.host = s.src
    UNION ALL
    SELECT h.r, s.kind, s.host, s.seed * (1 - {DAMPING} * held / mass)
    FROM seeds s JOIN masses USING (kind) JOIN (
      SELECT f.r, f.kind, sum(CASE WHEN o.src IS NULL THEN 0 ELSE f.score END) AS held
      FROM flow f LEFT JOIN sources o ON f.kind = o.kind AND f.host = o.src GROUP BY f.r, f.kind
    ) h ON h.kind = s.kind
  ) WHERE r < {rounds_for(DAMPING, FLOOR)} GROUP BY r, kind, host
), scores AS (
  SELECT host, sum(score) FILTER (kind = 'allow') AS trust, sum(score) FILTER (kind = 'block') AS distrust FROM flow JOIN masses USING (kind)
  WHERE r = {rounds_for(DAMPING, FLOOR)} AND score >= {FLOOR} * mass GROUP BY host
)
SELECT page_id, j.host, path, rule, coalesce(verdict,
  CASE WHEN coalesce(distrust, 0) > {BLOCK_OVER} * (coalesce(trust, 0) + coalesce(distrust, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN scores s ON j.host = s.host
"""


#: The query stops once scores stand still; this goes through all rounds.
SQL = _sql()
