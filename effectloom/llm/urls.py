r"""URL filters: explicit rules, then the purity of path templates.

A url's host and path are cut out by fixed rules.  An explicit rule decides the
urls it fits; the longest wins.  All other urls are judged by their template.

Templates form a tree per host.  Level by level, the children of a node are
counted; where nearly every url has a child of its own, the segment is variable
and becomes a wildcard (its file ending stays).  A node with fewer paths than a
variable one needs is left as it is, so the levels end where no larger node is
left, not at a fixed depth.  Then templates of a host that differ in one fixed
segment are compared: sorted by their smoothed share of bad pages they are cut
where two neighbours differ by more than chance (chi-square), and each group that
is even as a whole is merged; branches without labels join only where there is one
group.  A template is rejected if its share of bad labels, smoothed towards the
share of all labels, exceeds a threshold.

Everything works on distinct (host, path) with their counts.  Nodes are
aggregated before they are joined back, and the join key is salted by url, as one
host may hold a third of all pages.

null url, or one without `://`: host and path empty, one template.  Null or
repeated ids keep their rows.  An empty table gives an empty result; other
columns are not read.  Labels of unknown pages don't count; a page with several
labels is bad if one is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import carry, hot_keys, running_sum
from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16
WILD = "*"


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    has = F.coalesce(at > 0, F.lit(False))
    host = F.when(has, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")
    return host, F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_for(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of a short list of rules like ("block", "example.com/en/"), else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def wildcarded(paths: DataFrame, min_children: int, variety: float) -> DataFrame:
    """(host, path, n, labelled, bad) with the template of every path."""
    parts = F.split("path", "/")
    kept = ["host", "path", "n", "labelled", "bad"]
    now = paths.withColumns({
        "parts": F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "node": F.when(F.startswith("path", F.lit("/")), F.lit("")).otherwise(F.lit("~")),
        "salt": F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")})
    done = [now.filter(F.size("parts") == 0).select(*kept, F.col("node").alias("template"))]
    now, level = now.filter(F.size("parts") > 0), 0
    while True:
        now = now.withColumn("part", F.get("parts", F.lit(level)))
        child = now.groupBy("host", "node", "part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("paths"))
        # a node is variable where children are many and nearly as many as its urls
        grown = child.groupBy("host", "node").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("urls"), F.sum("paths").alias("paths")).filter(
            F.col("paths") >= min_children)
        variable = (F.col("children") >= min_children) & (F.col("children") >= F.col("urls") * variety)
        salted = grown.select("host", "node", variable.alias("variable"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        # a last empty part is the closing slash, no segment
        wild = F.when(F.col("part") == "", F.col("part")).otherwise(F.concat(F.lit(WILD), F.regexp_extract("part", r"(\.[A-Za-z][A-Za-z0-9]{0,5})$", 1)))
        rest = F.array_join(F.slice("parts", level + 1, F.size("parts")), "/")
        step = F.when(F.col("variable").isNull(), rest).when(F.col("variable"), wild).otherwise(F.col("part"))
        level += 1
        now = staged(now.join(salted, ["host", "node", "salt"], "left").select(
            *kept, "parts", "salt", F.concat("node", F.lit("/"), step).alias("node"),
            (F.col("variable").isNotNull() & (F.size("parts") > level)).alias("open")), "level")
        done.append(now.filter("NOT open").select(*kept, F.col("node").alias("template")))
        now = now.filter("open").drop("open")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, done)


def _even(bad: Column, labelled: Column, squares: Column, branches: Column) -> Column:
    """Whether shares vary no more than chance makes them: chi-square against its mean and two deviations."""
    share = F.try_divide(bad, labelled)
    # sum of (bad - labelled * p)^2 / (labelled * p * (1 - p)), from sums alone
    chi = F.coalesce(F.try_divide(squares - bad * share, share * (1 - share)), F.lit(0.0))
    freedom = F.greatest(branches - 1, F.lit(0))
    return chi <= freedom + 2 * F.sqrt(2.0 * freedom)


def merged(templates: DataFrame, weight: float) -> DataFrame:
    """(host, template, n, labelled, bad) with the name of the branch it is merged into."""
    now = templates.withColumn("merged", F.col("template"))
    # siblings have equally many segments, so a lone deep path asks for no level of its own
    length = F.size(F.split("template", "/"))
    deepest = now.groupBy("host", length.alias("length")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").agg(F.max("length")).first()[0] or 0
    group = ["host", "masked"]
    for level in range(1, deepest):
        branch = now.groupBy("host", "merged").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        split = F.split("merged", "/")
        fixed = F.get(split, F.lit(level))
        masked = F.array_join(F.transform(split, lambda s, i: F.when(i == level, F.lit(WILD)).otherwise(s)), "/")
        siblings = staged(branch.withColumn("masked", masked).filter(fixed.isNotNull() & ~F.startswith(fixed, F.lit(WILD)) & (fixed != "")), "siblings")
        pooled = siblings.groupBy(*group).agg(F.count(F.lit(1)).alias("branches"), F.try_divide(F.sum("bad"), F.sum("labelled")).alias("pool")).filter("branches > 1")
        work = siblings.join(pooled, group).withColumn(
            "share", (F.col("bad") + weight * F.coalesce("pool", F.lit(0.0))) / (F.col("labelled") + weight)).drop("pool", "branches")
        order = ["share", "merged"]
        hot = hot_keys(work, group)
        work = carry(work, group, order, {"before": F.when(F.col("labelled") > 0, F.struct("labelled", "bad"))}, hot=hot)
        l0, b0 = F.col("before.labelled"), F.col("before.bad")
        alike = _even(F.col("bad") + b0, F.col("labelled") + l0, F.try_divide(F.col("bad") * F.col("bad"), F.col("labelled")) + F.try_divide(b0 * b0, l0), F.lit(2))
        cut = F.when((F.col("labelled") > 0) & F.col("before").isNotNull() & ~alike, 1).otherwise(0)
        work = staged(running_sum(work, group, order, cut, "part", hot=hot).drop("before"), "parts")
        parts = work.groupBy(*group).agg(F.max("part").alias("last"))
        placed = work.join(parts, group).filter((F.col("last") == 0) | (F.col("labelled") > 0))
        squares = F.coalesce(F.sum(F.try_divide(F.col("bad") * F.col("bad"), F.col("labelled"))), F.lit(0.0))
        good = placed.groupBy(*group, "part").agg(
            F.count(F.lit(1)).alias("branches"), _even(F.sum("bad"), F.sum("labelled"), squares, F.count_if(F.col("labelled") > 0)).alias("even")).filter("branches > 1 AND even")
        # several groups of one mask are told apart by a number after the wildcard
        name = F.when(F.col("last") == 0, F.col("masked")).otherwise(F.array_join(F.transform(
            F.split("masked", "/"), lambda s, i: F.when(i == level, F.concat(F.lit(WILD + "~"), F.col("part"))).otherwise(s)), "/"))
        moved = placed.join(good, [*group, "part"]).select("host", "merged", name.alias("to"))
        now = staged(now.join(moved, ["host", "merged"], "left").withColumn("merged", F.coalesce("to", "merged")).drop("to"), "branches")
    return now


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = (), min_children: int = 8, variety: float = 0.2,
               weight: float = 4.0, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, bad_share.

    labels: (id of pages, bad 0 or 1).  weight: labelled pages that the share of
    all labels counts for; threshold: bad share above which a template is blocked.
    """
    host, path = host_and_path(url_col)
    urls = staged(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")), "urls")
    known = labels.select(F.col(id_col).alias("id"), F.col("bad").cast("int").alias("bad")).filter("id IS NOT NULL AND bad IS NOT NULL").groupBy("id").agg(F.max("bad").alias("bad"))
    paths = staged(urls.join(known, "id", "left").groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad")), "paths")
    tree = wildcarded(paths, min_children, variety)
    total = tree.agg(F.sum("labelled"), F.sum("bad")).first()
    prior = total[1] / total[0] if total[0] else 0.0
    leaves = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    named = merged(leaves, weight)
    purity = named.groupBy("host", "merged").agg(((F.sum("bad") + weight * prior) / (F.sum("labelled") + weight)).alias("bad_share"))
    judged = named.join(purity, ["host", "merged"]).select("host", "template", "merged", "bad_share").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")
    by_path = tree.select("host", "path", "template", salt.alias("salt")).join(judged, ["host", "template", "salt"]).select("host", "path", F.col("merged").alias("template"), "bad_share")
    rule, verdict = rule_for(rules, F.col("host"), F.col("path"))
    return urls.join(by_path, ["host", "path"]).select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bad_share") > threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", "bad_share")


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def labels_of_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page shows the document its last path segment numbers; bad is low quality or toxic."""
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]{1,18})(?:[.]html)?/?(?:[?#].*)?$', 1) AS BIGINT)")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    marked = labels.select("doc_id", bad.alias("bad")).filter("doc_id IS NOT NULL AND bad IS NOT NULL").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    return pages.select("page_id", number.alias("doc_id")).join(marked, "doc_id").select("page_id", "bad")
