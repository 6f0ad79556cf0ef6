"""URL filter: exact rules, and a path-template tree for the rest.

Rules name a host and a path prefix; the longest rule that fits a url's host (or a parent domain of it) and path decides.
Urls without a rule are judged by templates learned from all urls of their host:

1. Per host, a tree over path segments is walked level by level.  At a node whose children are many and seldom repeat
   (``MIN_KINDS`` kinds or more, fewer than ``MIN_REPEATS`` urls a kind) the segments are variable and become one
   wildcard (an extension such as ``.html`` is kept); numbers always do.  A template is the path with its wildcards.
2. Sibling templates of a host that differ in their first literal segment only are merged where their labelled block
   rates are statistically alike (two-proportion z below ``MERGE_Z``); neighbours in order of the rate are compared, so
   the work is linear in the number of siblings.
3. A merged template is rejected if its smoothed purity reaches ``REJECT``: block rate of its labelled urls, drawn
   towards the rate of the same template in the host's domain, and that towards the overall rate, by ``PRIOR`` pseudo
   urls each.  Unlabelled templates thus follow their domain or the overall rate and are allowed unless that is pure.

Labels are the verdicts of the rules, or a column of the caller's.  All steps are DataFrame operations on counts that
are aggregated per task first, so a host with a third of all urls is a few rows per task.

Edge cases: a null url or one without ``://`` has empty host and path, fits no rule and is allowed unless its template is
rejected; repeated rows and null ids each give their row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Stage

# Fixed values: (host, path prefix, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
DEPTH = 6               # path levels of the tree; what lies deeper is one tail wildcard
MIN_KINDS = 8
MIN_REPEATS = 5.0
MERGE_Z = 1.0
PRIOR = 4.0
REJECT = 0.9
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Add host and path."""
    parts = (df.withColumn("url_text", F.col(url)).withColumn("url_head", F.substring_index(F.col(url), "://", 1)))
    rest = F.when(F.contains(F.col("url_text"), F.lit("://")),
                  F.expr("substring(url_text, length(url_head) + 4)"))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return (parts.withColumn("host", F.translate(host, UPPER, UPPER.lower())).withColumn("path", path)
            .drop("url_text", "url_head"))


def rule_of(rules=None) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits host and path; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, prefix, action in sorted(rules or RULES, key=lambda r: (len(r[0] + r[1]), r)):   # longest is tried first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(prefix)
        rule = F.when(fits, F.lit(host + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def wildcard(segment: Column) -> Column:
    """``*`` with the segment's extension, if it has one."""
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1))


def templates(paths: DataFrame, stage: Stage, depth: int = DEPTH, min_kinds: int = MIN_KINDS,
              min_repeats: float = MIN_REPEATS) -> DataFrame:
    """paths(host, path, n, blocked, allowed), one row per host and path, with its ``template``."""
    state = paths.withColumn("segments", F.split(F.regexp_replace("path", "^/", ""), "/")).withColumn(
        "template", F.lit(""))
    for level in range(depth):
        here = F.get("segments", F.lit(level))
        state = stage.write(state.withColumn("segment", here), f"level-{level}")
        children = (state.filter("segment is not null").groupBy("host", "template", "segment")
                    .agg(F.sum("n").alias("n")))
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("urls"))
        variable = (nodes.filter((F.col("kinds") >= min_kinds) & (F.col("urls") < min_repeats * F.col("kinds")))
                    .select(F.col("host").alias("vh"), F.col("template").alias("vt")))
        joined = state.join(variable, (F.col("host") == F.col("vh")) & (F.col("template") == F.col("vt")), "left")
        number = F.col("segment").rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$")
        token = F.when(F.col("vh").isNotNull() | number, wildcard(F.col("segment"))).otherwise(F.col("segment"))
        state = joined.withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(
            F.concat("template", F.lit("/"), token))).drop("vh", "vt", "segment")
    tail = F.when(F.size("segments") > depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return stage.write(state.withColumn("template", tail).drop("segments"), "templates")


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def merged(counts: DataFrame, merge_z: float = MERGE_Z) -> DataFrame:
    """counts(host, template, blocked, allowed) with the ``branch`` each template was merged into and its sums."""
    signed = counts.withColumn("shape", F.regexp_replace("template", r"^/[^*/][^/]*", "/{}")).withColumn(
        "labelled", F.col("blocked") + F.col("allowed"))
    known = signed.filter("labelled > 0").withColumn("rate", F.col("blocked") / F.col("labelled"))
    siblings = W.partitionBy("host", "shape").orderBy("rate", "template")
    before = [F.lag(c).over(siblings).alias(f"{c}_0") for c in ("blocked", "labelled", "rate")]
    pairs = known.select("*", *before)
    pooled = (F.col("blocked") + F.col("blocked_0")) / (F.col("labelled") + F.col("labelled_0"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / F.col("labelled_0")))
    differs = F.coalesce(F.abs(F.col("rate") - F.col("rate_0")) >= merge_z * spread, F.lit(True)) & (
        F.coalesce(F.col("rate") != F.col("rate_0"), F.lit(True)))
    branched = pairs.withColumn("branch", F.sum(F.when(differs, 1).otherwise(0)).over(siblings))
    branch = W.partitionBy("host", "shape", "branch")
    done = branched.select("host", "template", "shape", F.col("branch").cast("long").alias("branch"),
                           F.sum("blocked").over(branch).alias("branch_blocked"),
                           F.sum("labelled").over(branch).alias("branch_labelled"))
    alone = signed.filter("labelled = 0").select("host", "template", "shape", F.lit(0).cast("long").alias("branch"),
                                                 F.lit(0).cast("long").alias("branch_blocked"),
                                                 F.lit(0).cast("long").alias("branch_labelled"))
    return done.unionByName(alone)


def purity(counts: DataFrame, branches: DataFrame, prior: float = PRIOR) -> DataFrame:
    """host, template, purity: the smoothed block rate of the template's branch."""
    base = counts.agg(((F.sum("blocked") + F.lit(1.0)) / (F.sum("blocked") + F.sum("allowed") + F.lit(2.0)))
                      .alias("rate")).first()
    rate = F.lit(float(base["rate"]) if base and base["rate"] is not None else 0.5)
    domains = (counts.groupBy(domain_of(F.col("host")).alias("domain"), F.col("template").alias("template_d"))
               .agg(F.sum("blocked").alias("db"), F.sum(F.col("blocked") + F.col("allowed")).alias("dn")))
    joined = branches.join(domains, (domain_of(F.col("host")) == F.col("domain"))
                           & (F.col("template") == F.col("template_d")))
    domain_rate = (F.col("db") + prior * rate) / (F.col("dn") + prior)
    return joined.select("host", "template", "branch", "branch_labelled", (
        (F.col("branch_blocked") + prior * domain_rate) / (F.col("branch_labelled") + prior)).alias("purity"))


def url_filter(pages: DataFrame, *, key: str = "page_id", url: str = "url", label: str | None = None,
               rules=None, reject: float = REJECT) -> DataFrame:
    """key, host, path, rule, verdict, template, purity for every row of ``pages``.

    ``label`` names a boolean column (blocked or not, null unknown); by default the rules' verdicts are the labels.
    """
    stage = Stage(pages.sparkSession, "urls")
    rule, decided = rule_of(rules)
    columns = [F.col(key).alias("key_of"), F.col(url).alias("url_of"),
               (F.col(label) if label else F.lit(None).cast("boolean")).alias("label_of")]
    urls = (split_url(pages.select(*columns), "url_of").withColumn("rule", rule).withColumn("decided", decided)
            .withColumn("bad", F.col("label_of") if label else F.col("decided") == "block"))
    paths = urls.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("blocked"),
        F.sum((~F.col("bad")).cast("long")).alias("allowed")).fillna(0, ["blocked", "allowed"])
    known = templates(paths, stage)
    counts = stage.write(known.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"),
                                                               F.sum("allowed").alias("allowed")), "counts")
    # written, so that the join below has plain shuffles on both sides and a hot host's template can be split
    judged = stage.write(purity(counts, merged(counts)), "judged")
    verdicts = known.select("host", "path", "template").join(judged, ["host", "template"]).select(
        F.col("host").alias("h"), F.col("path").alias("p"), "template", "purity")
    out = urls.join(verdicts, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    learned = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("key_of").alias(key), "host", "path", "rule",
                      F.coalesce("decided", learned).alias("verdict"), "template", "purity")
