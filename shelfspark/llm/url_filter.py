"""Operator 2: URL filter by a tree of path templates.

Method: each host's paths form a tree.  Segments that vary (numbers, identifiers) are
generalised to wildcards, and so are segments too rare among their siblings.  Of the
branches that are left below one node (at most ``1 / least_share`` and the wildcard), those
with labelled pages are put in the order of their blocked share; neighbours whose shares do
not differ significantly (two-proportion test) are merged into one branch, ``en|fr``, whose
subtrees are one from there on.  A template, a path to a leaf, is rejected if the smoothed
share of blocked pages among its labelled ones is high and it has enough of them.  Labels
are the verdicts of a rule list, which also decides directly: the longest rule that fits a
URL wins over the tree.

The tree has ``LEVELS`` levels, and goes on below a node as long as some path of it does and it
has ``least_pages`` pages: below fewer every branch is too rare, so all that follows is one ``*``.  Three jobs
for each level, over the pages of such nodes alone; a few very deep paths add none.

Pages are first counted by (host, template); the tree works on these counts, level by
level with joins on (host, branch), never on one host in one task.

Edge cases: a branch without labelled pages is merged with no other; a null URL or one without :// has an empty host and path, which is a host
like others; a template without labelled pages is allowed; repeated rows count and are
judged each; a very long URL is a deep path, or a long segment, like others; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import cut

LEVELS = 3
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]  # (allow or block, host/path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, A_Z, a_z), path


def fitting_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as its position in ``rules``; null if none does."""
    out = F.lit(None).cast("int")
    for i, (_, rule) in sorted(enumerate(rules), key=lambda r: len(r[1][1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def segment_shape(segment: Column) -> Column:
    """Numbers and identifiers as wildcards, anything else as it is."""
    return (
        F.when(segment.rlike("^[0-9]+$"), "{n}")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("{n}."), F.substring_index(segment, ".", -1)))
        .when(segment.rlike("^[0-9a-f-]{8,}$"), "{id}")
        .when(segment.rlike("[0-9]") & (F.length(segment) >= 6), "{v}")
        .otherwise(segment)
    )


def _totals(rows: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """``rows`` with the sums over rows of equal keys. Rows are written first: both sides of the join read them."""
    rows = cut(rows)
    sums = rows.groupBy(*keys).agg(*(F.sum(c).alias(f"{c}_{suffix}") for c in ("pages", "labelled", "blocked")), F.max(F.size("segments")).alias(f"deep_{suffix}"))
    return rows.join(sums, keys)


def _merged(tree: DataFrame, z: float) -> DataFrame:
    """(host, t, u, name): the branches u below each node (host, t), and the joint name of those that are similar."""
    sums = tree.groupBy("host", "t", "u").agg(*(F.sum(c).alias(c) for c in ("labelled", "blocked"))).where("labelled > 0")
    below = Window.partitionBy("host", "t").orderBy("rate", "u")  # 1 / least_share rows and one at most
    sums = sums.withColumn("rate", F.col("blocked") / F.col("labelled"))
    last = {c: F.lag(c).over(below) for c in ("labelled", "blocked", "rate")}
    both = (F.col("blocked") + last["blocked"]) / (F.col("labelled") + last["labelled"])
    same = F.col("rate") - last["rate"] <= z * F.sqrt(both * (1 - both) * (1 / F.col("labelled") + 1 / last["labelled"]))
    islands = sums.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("new").over(below))
    names = F.collect_list("u").over(Window.partitionBy("host", "t", "island"))
    return islands.select("host", "t", "u", F.array_join(F.array_sort(names), "|").alias("name"))


def template_verdicts(shapes: DataFrame, least_pages: int = 5, least_share: float = 0.02, z: float = 1.96, smoothing: float = 2.0, least_labelled: int = 5, purity: float = 0.8) -> DataFrame:
    """(host, segments, template, rejected) from counts of (host, segments): pages, labelled, blocked."""
    shapes = cut(shapes)
    share = shapes.agg(F.try_divide(F.sum("blocked"), F.sum("labelled")).alias("share")).first()["share"] or 0.0
    tree = _totals(shapes.withColumn("t", F.array().cast("array<string>")), ["host", "t"], "t")
    settled, k = None, 0
    while True:
        if k >= LEVELS:
            few, further = F.col("pages_t") < least_pages, F.col("deep_t") > k
            tree = cut(tree)
            done = tree.where(few | ~further).withColumn("t", F.when(further, F.concat("t", F.array(F.lit("*")))).otherwise(F.col("t")))
            settled = done if settled is None else settled.unionByName(done)
            tree = tree.where(~few & further)
            if tree.isEmpty():
                break
        tree = _totals(tree.drop("labelled_t", "blocked_t", "deep_t").withColumn("s", F.coalesce(F.get("segments", F.lit(k)), F.lit(""))), ["host", "t", "s"], "s")
        rare = F.col("pages_s") < F.greatest(F.lit(float(least_pages)), F.col("pages_t") * F.lit(least_share))
        tree = cut(tree.select(*shapes.columns, "t", F.when(rare, "*").otherwise(F.col("s")).alias("u")))
        tree = tree.join(_merged(tree, z), ["host", "t", "u"], "left").withColumn("t", F.concat("t", F.array(F.coalesce("name", "u")))).select(*shapes.columns, "t")
        tree, k = _totals(tree, ["host", "t"], "t"), k + 1
    tree = settled
    smooth = (F.col("blocked_t") + smoothing * share) / (F.col("labelled_t") + smoothing)
    rejected = (F.col("labelled_t") >= least_labelled) & (smooth >= purity)
    deeper = F.regexp_replace(F.concat_ws("/", F.slice("t", F.lit(LEVELS + 1), F.greatest(F.size("t") - LEVELS, F.lit(0)))), "/+$", "")
    template = F.concat(F.concat_ws("/", "host", F.slice("t", 1, LEVELS)), F.when(deeper != "", F.concat(F.lit("/"), deeper)).otherwise(""))
    return tree.select("host", "segments", template.alias("template"), rejected.alias("rejected"))


def judged_urls(pages: DataFrame, rules: list[Rule], bad: Column | None = None, **how) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits), verdict and template.

    ``bad``: further labels, true or false, of pages that no rule fits; null where unknown.
    They decide through their template's share only.
    """
    parts = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), (F.lit(None) if bad is None else bad).cast("boolean").alias("bad"))
    host, path = host_and_path(F.col("url"))
    parts = parts.select("page_id", "bad", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("fit", fitting_rule(rules, F.col("host"), F.col("path")))
    piece = F.split(F.regexp_replace("path", "/+$", ""), "/")
    parts = parts.withColumn("segments", F.transform(F.slice(piece, 2, F.greatest(F.size(piece) - 1, F.lit(0))), segment_shape))
    blocks = [i for i, (verdict, _) in enumerate(rules) if verdict == "block"]
    label = F.when(F.col("fit").isNotNull(), F.col("fit").isin(blocks)).otherwise(F.col("bad"))
    shapes = parts.groupBy("host", "segments").agg(F.count("*").alias("pages"), F.count(label).alias("labelled"), F.count_if(F.coalesce(label, F.lit(False))).alias("blocked"))
    out = parts.join(template_verdicts(shapes, **how), ["host", "segments"])
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("fit"))
    verdict = F.coalesce(pick([v for v, _ in rules]), F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", pick([r for _, r in rules]).alias("rule"), verdict.alias("verdict"), "template")
