"""URL filters by rules and by link-graph propagation; DataFrame functions only.

A rule is a host and a path prefix, such as `example.net/en/`; it fits its host and all subdomains
where the url's path starts with the rule's, and the longest rule that fits decides. Where none fits,
the host's place in the link graph does. Hosts with pages that an allow rule fits are trusted seeds,
hosts that a block rule covers whole (path `/`) are blocked seeds, whether they have pages or are only linked to. Trust runs by personalised PageRank
from the trusted seeds along host edges (absolute links in the pages, weighted by the pages that have
them), and distrust runs from the blocked seeds against them; scores are in units of one
seed. A third run, against the links from every host, says how much could have reached a host; the part of it
that came from blocked seeds is the host's share of distrust, which doesn't depend on how many hosts link to a blocked one.
A host is blocked if its share is at least `least` and its distrust exceeds its trust; a host
that neither reaches is allowed. Scores are run until what still moves is a billionth of the seeds.

Scale. Rules join on the suffixes of the distinct hosts, not on pages. Links are made distinct inside the page and
counts combine before the shuffle, so a host with a third of all pages is one row for each task and
target; each round of the propagation is an equi-join of edges and scores by host, with hot hosts left to
adaptive splitting, and every few rounds the scores are written to the shared folder, in place of those before. Tables of hosts and rules
are broadcast only where Spark sees that their files are small.

Results for odd input: a null url or one without `://` has an empty host and path and is allowed; null html has no
links; pages may repeat; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch, kept_table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FOLLOW, LEAST, ROUNDS, TOLERANCE = 0.85, 0.1, 300, 1e-9
#: Rounds between two tables of scores.
AT_ONCE = 5
#: Differences that come from the order of sums alone.
NOISE = 1e-6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host of an absolute or protocol-relative link.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    split = [(r, r.split("/", 1)[0], "/" + r.split("/", 1)[1] if "/" in r else "", v) for r, v in rules]
    rows = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("rule", "rule_host", "rule_path", "verdict"), row, strict=True)]) for row in split])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def host_rules(hosts: DataFrame, rules: DataFrame, most_labels: int) -> DataFrame:
    """hosts (host): for each host that a rule may fit, the rules, longest first. No rule's host has more than most_labels."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffix = F.explode(F.transform(F.sequence(F.greatest(F.lit(1), n - most_labels + 1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")))
    fits = hosts.filter("host <> ''").withColumn("suffix", suffix).join(rules, F.col("suffix") == F.col("rule_host"))
    # A block rule goes before an equal allow rule.
    rank = F.struct(F.length("rule").alias("length"), (F.col("verdict") == "block").alias("block"), "rule", "rule_path", "verdict")
    return fits.groupBy("host").agg(F.sort_array(F.collect_set(rank), asc=False).alias("rules"))


def propagate(seeds: DataFrame, edges: DataFrame, follow: float = FOLLOW, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank. seeds (kind, host, seed), edges (kind, src, dst, share): (kind, host, score)."""
    spark = seeds.sparkSession
    start = kept_table(seeds.select("kind", "host", (F.col("seed") * (1 - follow)).alias("score")), "seeds")
    steps = kept_table(edges.withColumnRenamed("src", "host"), "edges")
    mass = start.agg(F.sum("score")).first()[0] or 0.0
    if steps.isEmpty():
        return start
    scores, last = start, Scratch(spark)
    for _ in range(0, rounds, AT_ONCE):
        new, own = scores, Scratch(spark)
        for _ in range(AT_ONCE):
            passed = new.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * follow).alias("score"))
            new = start.unionByName(passed).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        new = own.keep(new, "scores")
        moved = new.alias("n").join(scores.withColumnRenamed("score", "old"), ["kind", "host"], "left").agg(F.sum(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))))).first()[0]
        last.clear()
        scores, last = new, own
        if (moved or 0.0) <= tolerance * mass:
            return scores
    raise RuntimeError(f"scores did not settle in {rounds} rounds")


def shares(edges: DataFrame) -> DataFrame:
    """edges (src, dst, weight): steps along them for trust, against them for distrust and for what could have come."""
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = both.unionByName(both.filter("kind = 'distrust'").withColumn("kind", F.lit("reach")))
    total = both.groupBy(F.col("kind").alias("k"), F.col("src").alias("s")).agg(F.sum("weight").alias("total"))
    joined = both.join(total, (F.col("kind") == F.col("k")) & (F.col("src") == F.col("s")))
    return joined.select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def judge(pages: DataFrame, rules=RULES, least: float = LEAST, follow: float = FOLLOW, rounds: int = ROUNDS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the host's trust, distrust and share of distrust."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url").cast("string"))
    linked = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(LINK), 1), lambda x: F.translate(x, UPPER, LOWER)))
    read = kept_table(pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), linked.alias("linked")), "pages")
    edges = read.select(F.col("host").alias("src"), F.explode("linked").alias("dst")).filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    edges = kept_table(edges, "links")
    most_labels = max((r.split("/", 1)[0].count(".") + 1 for r, _ in rules), default=1)
    hosts = read.select("host").union(edges.select("dst")).distinct()
    fitting = kept_table(host_rules(hosts, rule_table(spark, rules), most_labels), "host-rules")
    ruled = read.join(fitting.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left").drop("h")
    ruled = ruled.withColumn("best", F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0)))

    trusted = ruled.filter("best.verdict = 'allow'").select(F.lit("trust").alias("kind"), "host").distinct()
    blocked = fitting.filter(F.exists("rules", lambda r: (r["verdict"] == "block") & (r["rule_path"] == "/"))).select(F.lit("distrust").alias("kind"), "host")
    every = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct().select(F.lit("reach").alias("kind"), "host")
    seeds = trusted.unionByName(blocked).unionByName(every).withColumn("seed", F.lit(1.0))
    scores = propagate(seeds, shares(edges), follow, rounds)
    pick = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    seeded = blocked.select(F.col("host").alias("s"), F.lit(True).alias("seeded"))
    by_host = scores.groupBy(F.col("host").alias("h")).agg(pick("trust"), pick("distrust"), pick("reach")).join(seeded, F.col("h") == F.col("s"), "left").drop("s")
    came = F.col("reach") - (1 - follow)
    share = F.when(F.col("seeded"), 1.0).when(came > 0, F.col("distrust") / came).otherwise(0.0)
    by_host = kept_table(by_host.withColumn("distrust_share", share).drop("reach", "seeded"), "host-scores")
    judged = ruled.join(by_host, F.col("host") == F.col("h"), "left")
    trust, distrust, share = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust", "distrust_share"))
    method = F.when((share >= least - NOISE) & (distrust > trust + NOISE), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"), share.alias("distrust_share"))
