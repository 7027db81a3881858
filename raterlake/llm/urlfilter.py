"""URL filter: host and path rules, and a tree of path templates per host for the urls that no rule decides.

The tree is built level by level with aggregates: below a template, a segment stays literal if its parent has at most
``max_children`` different segments or the segment holds at least ``min_share`` of the parent's urls; all others become the
wildcard ``*``. It goes on until no template has two paths with a further segment; the rest of a path that is alone stays literal. Branches of a host that differ in literals only, so with the same
shape, are merged when they are statistically similar: the share of different paths among a branch's urls and the bad share of its
labelled ones lie within three standard errors of the shape's. A (merged) template is rejected when at least half of its urls carry a label and its
purity, (blocked + weight * overall share) / (labelled + weight), is ``reject`` or more.

Labels are the rules' own verdicts, or a boolean column (true: bad). Defined results: a null url, or one without ``://``, has
empty host and path, fits no rule, belongs to the empty template, and is allowed unless its labels reject it; rows that
repeat count as often as they occur. Keys may be hot: counts are partial aggregates, and rows of a hot key are dealt over salts when joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterlake.llm.shared import checkpoint, dealt

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule that fits (null if none); a short, fixed list such as "net/es/"."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _joined(rows: DataFrame, counts: DataFrame, keys: list[str], n: str, by: Column, how: str = "inner") -> DataFrame:
    """rows with the columns of counts (n isn't taken over), hot keys dealt."""
    rows, counts = dealt(rows, counts, keys, n, by)
    return rows.join(counts.drop(n), [*keys, "_salt"], how).drop("_salt")


def templates(urls: DataFrame, host: str, path: str, max_children: int = 10, min_share: float = 0.1) -> DataFrame:
    """Each distinct host and path of urls with n (urls), n_labelled, n_bad and its template. urls has host, path and
    label (boolean or null)."""
    paths = urls.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path")).agg(
        F.count("*").alias("n"),
        F.count("label").alias("n_labelled"),
        F.sum(F.when(F.col("label"), 1).otherwise(0)).alias("n_bad"),
    )
    # Each level uses the one before several times, so lineage is cut at each.
    open_ = checkpoint(paths.withColumn("_segments", F.slice(F.split("_path", "/"), 2, 1 << 20)).withColumn("_template", F.lit("")))
    place = F.xxhash64("_host", "_path")
    out, level = [], 0
    while True:
        done = F.size("_segments") <= level
        out.append(open_.filter(done))
        there = open_.filter(~done).withColumn("_segment", F.get("_segments", F.lit(level)))
        nodes = checkpoint(there.groupBy("_host", "_template", "_segment").agg(F.sum("n").alias("_n"), F.count("*").alias("_paths")))
        if nodes.isEmpty():
            break
        parents = nodes.groupBy("_host", "_template").agg(F.count("*").alias("_children"), F.count("*").alias("_rows"), F.sum("_n").alias("_all"), F.sum("_paths").alias("_open"))
        of_parent = _joined(nodes, checkpoint(parents), ["_host", "_template"], "_rows", F.xxhash64("_segment"))
        literal = (F.col("_children") <= max_children) | (F.col("_n") >= F.col("_all") * min_share)
        verdicts = checkpoint(of_parent.select("_host", "_template", "_segment", "_paths", literal.alias("_literal"), (F.col("_open") == 1).alias("_alone")))
        grown = _joined(there, verdicts, ["_host", "_template", "_segment"], "_paths", place)
        own = F.when(F.col("_alone"), F.array_join(F.slice("_segments", level + 1, 1 << 20), "/")).when(F.col("_literal"), F.col("_segment")).otherwise("*")
        grown = grown.withColumn("_template", F.concat("_template", F.lit("/"), own))
        # A path that is alone needs no further level.
        grown = grown.withColumn("_segments", F.when(F.col("_alone"), F.slice("_segments", 1, level + 1)).otherwise(F.col("_segments")))
        open_ = checkpoint(grown.drop("_segment", "_literal", "_alone"))
        level += 1
    return reduce(DataFrame.unionByName, out).select("_host", "_path", "n", "n_labelled", "n_bad", "_template")


def template_verdicts(paths: DataFrame, weight: float = 10.0, reject: float = 0.7) -> DataFrame:
    """_host, _template, _paths (their number), purity, rejected: from the paths with their templates."""
    shape = F.array_join(F.transform(F.split("_template", "/"), lambda x: F.when((x == "*") | (x == ""), x).otherwise("?")), "/")
    branches = paths.groupBy("_host", "_template").agg(F.sum("n").alias("n"), F.count("*").alias("_paths"), F.sum("n_labelled").alias("n_labelled"), F.sum("n_bad").alias("n_bad"))
    branches = checkpoint(branches.withColumn("_shape", shape))
    total = branches.agg(F.sum("n_bad").alias("bad"), F.sum("n_labelled").alias("labelled")).first()
    overall = (total["bad"] or 0) / max(total["labelled"] or 0, 1)
    place = F.xxhash64("_host", "_template")
    shapes = checkpoint(branches.groupBy("_host", "_shape").agg((F.sum("_paths") / F.sum("n")).alias("_share"), F.try_divide(F.sum("n_bad"), F.sum("n_labelled")).alias("_rate"), F.count("*").alias("_rows")))

    def close(share: Column, mean: str, n: str) -> Column:
        return F.abs(share - F.col(mean)) <= 3 * F.sqrt(F.col(mean) * (1 - F.col(mean)) / F.col(n)) + 1 / F.col(n)

    near = close(F.col("_paths") / F.col("n"), "_share", "n") & ((F.col("n_labelled") == 0) | close(F.try_divide("n_bad", "n_labelled"), "_rate", "n_labelled"))
    groups = _joined(branches, shapes, ["_host", "_shape"], "_rows", place).withColumn("_group", F.when(near, F.col("_shape")).otherwise(F.concat(F.lit("="), F.col("_template"))))
    groups = checkpoint(groups)
    merged = checkpoint(groups.groupBy("_host", "_group").agg(F.sum("n").alias("_n"), F.sum("n_labelled").alias("_labelled"), F.sum("n_bad").alias("_bad"), F.count("*").alias("_rows")))
    out = _joined(groups.select("_host", "_template", "_group", "_paths"), merged, ["_host", "_group"], "_rows", place)
    purity = (F.col("_bad") + weight * overall) / (F.col("_labelled") + weight)
    return out.select("_host", "_template", "_paths", purity.alias("purity"), ((F.col("_labelled") * 2 >= F.col("_n")) & (purity >= reject)).alias("rejected"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", labels: str | None = None) -> DataFrame:
    """The rows of pages with host, path, rule, verdict ("allow" or "block"), template and purity (clashing columns are
    dropped). rules: pairs of verdict and rule. labels: a boolean column, true for bad pages, instead of the rules'."""
    made = ["host", "path", "rule", "verdict", "template", "purity", "label", "rejected", "_host", "_path", "_template", "_salt", "_salts", "_n", "_rule_verdict"]
    rows = pages.drop(*(c for c in made if c not in (url, labels)))
    host, path = host_and_path(F.col(url))
    verdict_of = F.create_map(*(F.lit(x) for v, r in rules for x in (r, v))) if rules else F.create_map().cast("map<string,string>")
    rows = rows.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("rule", rule_column(F.col("host"), F.col("path"), [r for _, r in rules]))
    rows = rows.withColumn("_rule_verdict", F.get(F.array(F.element_at(verdict_of, F.col("rule"))), F.lit(0)))
    label = F.col(labels) if labels else F.col("_rule_verdict") == "block"
    paths = templates(rows.select("host", "path", label.alias("label")), "host", "path")
    paths = checkpoint(paths)
    judged = _joined(paths.select("_host", "_path", "_template", F.col("n").alias("_n")), checkpoint(template_verdicts(paths)), ["_host", "_template"], "_paths", F.xxhash64("_path"))
    judged = checkpoint(judged).withColumnsRenamed({"_host": "host", "_path": "path"})
    # Rows of one url are told apart by their other columns.
    plain = [c for c in rows.columns if not isinstance(rows.schema[c].dataType, (T.MapType, T.VariantType))]
    out = _joined(rows, judged, ["host", "path"], "_n", F.xxhash64(*plain), "left")
    by_method = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce("_rule_verdict", by_method)).withColumn("template", F.col("_template")).drop("_rule_verdict", "rejected", "_template")
