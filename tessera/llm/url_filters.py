"""Operator 2: url rules, and trust and distrust over the host graph for urls that no rule fits.

Rules (host, path, verdict) fit a host with all its subdomains and a path prefix; the longest
wins.  For the other urls the method decides for the whole host:

* host edges: ``href`` targets of the pages, resolved against the page's host, and an edge
  each way between a host and the next enclosing domain that also has pages;
* trust: personalised PageRank along the edges from hosts with pages that a rule allows;
* distrust: the same over reversed edges, from hosts with pages that a rule blocks (who links
  to blocked hosts is distrusted);
* a host is blocked when its distrust is at least ``ratio`` times its trust and at least
  ``least`` times an even share of all distrust.

Only DataFrame functions are used.  A null url, or one without ``://``, has an empty host and
path: no rule fits it and no edge touches it; the verdict is allow.  Repeated pages count once
each in seeds and their links once.  Hosts that cannot be reached have score 0.  Null html has
no links.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.session import materialize

# (host, path, verdict), fixed values of the query
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING = 0.85
TOLERANCE = 1e-6     # the sum of all changes of a round at which scores count as settled
RATIO = 2.0
LEAST = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url) -> tuple[F.Column, F.Column]:
    """Host and path of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("1"))
    after = F.regexp_replace(url, r"^(?s:.*?)://", "")
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.when(rest.isNotNull(), host).otherwise(""), F.when(rest.isNotNull(), path).otherwise("")


def best_rule(host, path, rules) -> F.Column:
    """The longest rule that fits, as struct (length, rule, verdict), else null.

    Rules are few and given by the caller, so they become one expression: nothing is joined.
    """
    fits = [F.when((host.eqNullSafe(F.lit(h)) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in rules]
    return F.greatest(F.lit(None).cast("struct<length:int,rule:string,verdict:string>"), *fits)


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct host edges (src, dst) from links and from enclosing domains.

    ``pages`` has host and html.  Links are made distinct within a page first, so a page that
    repeats one link, or a host with a third of all pages, adds one row for each task.
    """
    href = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)\bhref\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1)))
    links = (pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(href).alias("link"))
             .select("src", F.translate(F.regexp_extract("link", r"^(?i:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1), UPPER, LOWER).alias("dst")))
    hosts = pages.filter("host <> ''").select("host").distinct()
    # enclosing domains of a host, the nearest that is itself a host of the pages
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))),
                                                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("far", "up"))
    near = (above.join(hosts.select(F.col("host").alias("up")), "up")
            .groupBy("host").agg(F.min(F.struct("far", "up")).alias("m")).select("host", F.col("m.up").alias("up")))
    tree = near.select(F.col("host").alias("src"), F.col("up").alias("dst"))
    tree = tree.union(near.select(F.col("up").alias("src"), F.col("host").alias("dst")))
    return links.union(tree).filter("src <> dst AND dst <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: (host, score), of which the scores sum to 1 at most.

    ``seeds`` is (host, seed) with weights that sum to 1.  Mass of hosts without outgoing edges
    is lost, which keeps hosts that nothing links on at their seed.  Rounds run until the
    total change is below ``tolerance``; each is written to the shared folder.
    """
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    weighted = materialize(edges.join(out, "src").select("src", "dst", (F.lit(damping) / F.col("n")).alias("w")), "host-edges")
    base = materialize(seeds.select("host", (F.col("seed") * (1 - damping)).alias("base")), "host-seeds")
    score = base.select("host", F.col("base").alias("score"))
    while True:
        got = (weighted.join(score.withColumnRenamed("host", "src"), "src")
               .groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("w") * F.col("score")).alias("got")))
        new = (base.join(got, "host", "full")
               .select("host", (F.coalesce("base", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("score")))
        new = materialize(new, "host-scores")
        moved = (new.join(score.withColumnRenamed("score", "old"), "host", "full")
                 .agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0])
        score = new
        if (moved or 0.0) < tolerance:
            return score


def host_verdicts(pages: DataFrame, ratio: float = RATIO, least: float = LEAST) -> DataFrame:
    """(host, trust, distrust, blocked) for pages with host, html and the rule's verdict."""
    seeds = (pages.filter("host <> '' AND ruled IS NOT NULL").groupBy("host")
             .agg(F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("allow"),
                  F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("block")))
    seeds = materialize(seeds, "host-rules")
    total = seeds.agg(F.sum("allow").alias("a"), F.sum("block").alias("b")).first()
    edges = materialize(host_edges(pages), "host-links")
    hosts = pages.filter("host <> ''").select("host").distinct()
    part = lambda col, n: seeds.filter(F.col(col) > 0).select("host", (F.col(col) / F.lit(float(n or 1))).alias("seed"))
    trust = propagate(edges, part("allow", total["a"])).withColumnRenamed("score", "trust")
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = propagate(turned, part("block", total["b"])).withColumnRenamed("score", "distrust")
    scored = hosts.join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0, ["trust", "distrust"])
    even = least / max(hosts.count(), 1)
    bad = (F.col("distrust") >= ratio * F.col("trust")) & (F.col("distrust") >= even)
    return scored.select("host", "trust", "distrust", bad.alias("blocked"))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               ratio: float = RATIO, least: float = LEAST) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages``."""
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    rule = best_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("best", rule).select("page_id", "host", "path", "html", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))
    hosts = host_verdicts(rows, ratio, least)
    return (rows.drop("html").join(hosts, "host", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "trust", "distrust"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
