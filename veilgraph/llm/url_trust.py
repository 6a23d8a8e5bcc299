"""URL rules, and for what they leave open trust and distrust that spread over links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.store import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and protocol-relative targets of href attributes.
HREF = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]*)"""


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Adds host and path of ``url``: host from the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path from there up to ``?``, ``#`` or the end. A null url, or one without ``://``, has both empty."""
    rest = _rest(F.col("url"))
    return pages.withColumns(
        {
            "host": F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.lit("")),
            "path": F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")),
        }
    )


def rule_columns(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none fits. Rules: (verdict, host + path)."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): how many links lead from pages of one host to another host."""
    links = with_host_and_path(pages.select("url", "html")).select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("to"))
    target = links.select("src", F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to")).alias("url"))
    return with_host_and_path(target).filter("src != '' and host != '' and src != host").groupBy("src", F.col("host").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, scratch: Scratch, *, damping: float = 0.85, steps: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank of trust along links, and of distrust against them.

    ``seeds`` has host, trust0 and distrust0 (each sums to 1 or 0). Rank that reaches a host without further links
    goes back to the seeds. Each step joins ranks with edges and sums by host, with sums combined before the shuffle,
    and writes its table, so the plan doesn't grow and lost executors cost one step. Stops when the ranks move by no more
    than ``tolerance`` in sum, which takes about log(tolerance) / log(damping) steps (85); not to get there within
    ``steps`` is an error.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("leaving"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("entering"))
    shares = scratch.put(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("weight") / F.col("leaving")).alias("forth"), (F.col("weight") / F.col("entering")).alias("back")), "shares")
    none, no = F.lit(0.0), F.lit(False)
    nodes = scratch.put(
        seeds.select("host", "trust0", "distrust0", no.alias("sends"), no.alias("takes"))
        .union(shares.select("src", none, none, F.lit(True), no))
        .union(shares.select("dst", none, none, no, F.lit(True)))
        .groupBy("host")
        .agg(F.sum("trust0").alias("trust0"), F.sum("distrust0").alias("distrust0"), F.max("sends").alias("sends"), F.max("takes").alias("takes")),
        "nodes",
    )
    ranks = nodes.withColumns({"trust": F.col("trust0"), "distrust": F.col("distrust0"), "change": none})
    if shares.isEmpty():
        return ranks.drop("sends", "takes", "change")
    for step in range(steps):
        # what hosts with links pass on; the rest goes back to the seeds
        change, forth, back = ranks.agg(F.sum("change"), F.sum(F.when(F.col("sends"), F.col("trust"))), F.sum(F.when(F.col("takes"), F.col("distrust")))).first()
        if step and change <= tolerance:
            scratch.drop("shares")
            return ranks.drop("sends", "takes", "change")
        moved = (
            ranks.join(shares, ranks.host == shares.src)
            .select(F.col("dst").alias("host"), (F.col("trust") * F.col("forth")).alias("t"), none.alias("d"))
            .union(ranks.join(shares, ranks.host == shares.dst).select(F.col("src"), none, F.col("distrust") * F.col("back")))
            .groupBy("host")
            .agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        )
        trust = damping * F.coalesce("t", none) + (1 - damping * (forth or 0.0)) * F.col("trust0")
        distrust = damping * F.coalesce("d", none) + (1 - damping * (back or 0.0)) * F.col("distrust0")
        new = ranks.join(moved, "host", "left").select("host", "trust0", "distrust0", "sends", "takes", trust.alias("trust"), distrust.alias("distrust"), (F.abs(trust - F.col("trust")) + F.abs(distrust - F.col("distrust"))).alias("change"))
        ranks = scratch.put(new, f"ranks{step}")
        scratch.drop(f"ranks{step - 1}")
    raise RuntimeError(f"after {steps} steps the ranks still move by more than {tolerance}")


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, margin: float = 0.5, damping: float = 0.85, steps: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """A verdict for every page: that of the longest fitting rule, else that of its host's trust and distrust.

    Seeds are hosts of which rules allow (trusted) or block (distrusted) at least half of the pages. A host is blocked if its distrust exceeds its trust by more than ``margin`` times the mean seed
    share (1 over the number of seeds of the kind), else allowed. Pages with an empty host have no links and are
    allowed unless a rule fits. Null html has no links; repeated rows count and return as often as they come; extra
    columns don't matter. Returns page_id, host, path, rule, verdict, trust, distrust.
    """
    scratch = Scratch(pages.sparkSession)
    name, verdict = rule_columns(rules)
    judged = with_host_and_path(pages.select("page_id", "url")).withColumn("rule", name).withColumn("by_rule", verdict)
    hosts = (
        judged.filter("host != ''")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
        .select("host", (2 * F.col("allowed") >= F.col("n")).cast("double").alias("good"), (2 * F.col("blocked") >= F.col("n")).cast("double").alias("bad"))
    )
    hosts = scratch.put(hosts, "hosts")
    good, bad = hosts.agg(F.sum("good"), F.sum("bad")).first()
    seeds = hosts.select("host", (F.col("good") / max(good or 0.0, 1.0)).alias("trust0"), (F.col("bad") / max(bad or 0.0, 1.0)).alias("distrust0"))
    edges = scratch.put(host_edges(pages), "edges")
    ranks = propagate(seeds, edges, scratch, damping=damping, steps=steps, tolerance=tolerance)
    limit = margin / max(bad or 0.0, 1.0)
    scores = scratch.put(ranks.select("host", "trust", "distrust"), "scores")
    scratch.drop("hosts", "edges", "nodes")
    found = judged.join(scores, "host", "left")
    by_method = F.when(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) > limit, F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
