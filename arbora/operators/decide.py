"""Thresholds, votes, tuners and out-of-distribution flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import f1, ratio
from .hierarchy import close_labels, paths

By = Sequence[str]
#: Grids of the two tuners: 0.02 to 0.98, and 0 to 1.
GRID = tuple(k / 50 for k in range(1, 50))
DENSE_GRID = tuple(k / 100 for k in range(101))


def apply_thresholds(scores: DataFrame, default: float, thresholds: DataFrame | None = None) -> DataFrame:
    """Cells (.., label, s) at or over the label's own threshold (label, threshold), or the default."""
    if thresholds is None:
        return scores.where(F.col("s") >= F.lit(float(default)))
    met = scores.join(thresholds.select("label", "threshold"), "label", "left")
    return met.where(F.col("s") >= F.coalesce("threshold", F.lit(float(default)))).drop("threshold")


def selected_labels(scores: DataFrame, row: str = "row") -> DataFrame:
    """(row, labels): selected cells as one list of (label, score), best first, ties by label."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("n"), "label", F.col("s").alias("score"))))
    return scores.groupBy(row).agg(F.transform(order, lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))).alias("labels"))


def _at_or_under(s: Column, values: Sequence[float], lo: int, hi: int) -> Column:
    """How many of the sorted values are at or under s: a binary search written out as comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(s >= F.lit(float(values[mid])), _at_or_under(s, values, mid + 1, hi)).otherwise(_at_or_under(s, values, lo, mid))


def tune_threshold(cells: DataFrame, by: By = (), grid: Sequence[float] = GRID, lowest: bool = True, keep_all: bool = False) -> DataFrame:
    """The threshold of a grid with the best micro-F1 (ties: lowest, or highest), in one pass over dense cells.

    Each cell falls to the largest grid value at or under its score; true and predicted counts add up from
    the top. keep_all returns every candidate.
    """
    values = sorted(grid)
    step = _at_or_under(F.col("s"), values, 0, len(values))
    return best_threshold(cells.groupBy(*by, step.alias("k")).agg(F.sum("y").alias("y"), F.count("*").alias("n")), by, grid, lowest, keep_all)


def best_threshold(per: DataFrame, by: By = (), grid: Sequence[float] = GRID, lowest: bool = True, keep_all: bool = False) -> DataFrame:
    """The threshold of tune_threshold from the gold and all cells of each step (by, k, y, n)."""
    values = sorted(grid)
    table = F.array(*(F.lit(float(v)) for v in values))
    dims = per.sparkSession.range(len(values) + 1).select(F.col("id").cast("int").alias("k"))
    if by:
        dims = per.select(*by).distinct().crossJoin(F.broadcast(dims))
    full = dims.join(per, [*by, "k"], "left").fillna(0, ["y", "n"])
    down = Window.partitionBy(*by).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    run = full.withColumns({"tp": F.sum("y").over(down), "pred": F.sum("n").over(down), "gold": F.sum("y").over(Window.partitionBy(*by))}).where("k > 0")
    scored = run.select(*by, F.element_at(table, F.col("k")).alias("threshold"), f1(F.col("tp"), F.col("pred") - F.col("tp"), F.col("gold") - F.col("tp")).alias("micro_f1"))
    if keep_all:
        return scored
    tie = -F.col("threshold") if lowest else F.col("threshold")
    return scored.groupBy(*by).agg(F.max_by("threshold", F.struct("micro_f1", tie)).alias("threshold"), F.max("micro_f1").alias("micro_f1"))


def votes(selections: DataFrame, by: By = (), row: str = "row", label: str = "label") -> DataFrame:
    """(by, row, label, votes): members that selected a cell (by, member, row, label)."""
    return selections.select(*by, "member", row, label).distinct().groupBy(*by, row, label).agg(F.count("*").alias("votes"))


def majority(members: int) -> int:
    """Fewest votes that are more than half."""
    return members // 2 + 1


def tune_k(voted: DataFrame, truth: DataFrame, members: int, by: By = ()) -> DataFrame:
    """The votes k with the best micro-F1 (ties: the larger), from (by, row, label, votes) and gold (row, label)."""
    gold = truth.select("row", "label").distinct()
    total = gold.agg(F.count("*").alias("gold"))
    per = voted.join(gold.withColumn("y", F.lit(1)), ["row", "label"], "left").groupBy(*by, "votes").agg(F.sum(F.coalesce("y", F.lit(0))).alias("y"), F.count("*").alias("n"))
    return best_k(per, total, members, by)


def best_k(per: DataFrame, total: DataFrame, members: int, by: By = ()) -> DataFrame:
    """The k of tune_k from right and all cells of each number of votes (by, votes, y, n), and the number of gold cells (gold)."""
    dims = per.sparkSession.range(1, members + 1).select(F.col("id").alias("votes"))
    if by:
        dims = per.select(*by).distinct().crossJoin(F.broadcast(dims))
    down = Window.partitionBy(*by).orderBy(F.desc("votes")).rowsBetween(Window.unboundedPreceding, 0)
    run = dims.join(per, [*by, "votes"], "left").fillna(0, ["y", "n"]).withColumns({"tp": F.sum("y").over(down), "pred": F.sum("n").over(down)}).crossJoin(F.broadcast(total))
    scored = run.select(*by, F.col("votes").alias("k"), f1(F.col("tp"), F.col("pred") - F.col("tp"), F.col("gold") - F.col("tp")).alias("micro_f1"))
    return scored.groupBy(*by).agg(F.max_by("k", F.struct("micro_f1", "k")).alias("k"), F.max("micro_f1").alias("micro_f1"))


def closed_votes(selections: DataFrame, closed: DataFrame) -> DataFrame:
    """Votes in node space: each member's labels closed under ancestors first."""
    up = selections.join(closed.select("label", "ancestor"), "label").select("member", "row", F.col("ancestor").alias("label"))
    return votes(up)


def soft_vote(scores: DataFrame, members: int, weights: DataFrame | None = None, by: By = ()) -> DataFrame:
    """(by, row, label, s): mean over all members, or weighted by (member, w); a member without a score counts as 0."""
    if weights is None:
        return scores.groupBy(*by, "row", "label").agg((F.sum("s") / F.lit(float(members))).alias("s"))
    good = F.when(F.col("w") < 0, F.raise_error(F.lit("a weight is negative"))).otherwise(F.col("w"))
    total = weights.agg(F.sum(good).alias("total"))
    checked = F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(F.raise_error(F.lit("weights sum to nothing")))
    share = weights.crossJoin(F.broadcast(total)).select("member", checked.alias("share"))
    return scores.join(F.broadcast(share), "member").groupBy(*by, "row", "label").agg(F.sum(F.col("s") * F.col("share")).alias("s"))


def hard_majorities(voted: DataFrame, members: int, default: float, thresholds: DataFrame | None = None) -> DataFrame:
    """Cells with a majority whose vote fraction reaches the label's threshold."""
    fractions = voted.where(F.col("votes") >= majority(members)).withColumn("s", F.col("votes") / F.lit(float(members)))
    return apply_thresholds(fractions, default, thresholds)


def leave_one_out(selections: DataFrame, truth: DataFrame, members: DataFrame) -> DataFrame:
    """(left_out, micro_f1): majority votes of the other members; a member's own votes are taken off, not recounted."""
    names = members.select(F.col("member").alias("left_out")).distinct()
    n = names.agg(F.count("*").alias("m"))
    chosen = selections.select("member", "row", "label").distinct()
    cells = chosen.groupBy("row", "label").agg(F.count("*").alias("all"), F.collect_set("member").alias("by"))
    each = cells.crossJoin(F.broadcast(names)).crossJoin(F.broadcast(n))  # members: a handful
    kept = each.where(F.col("all") - F.when(F.array_contains("by", F.col("left_out")), 1).otherwise(0) >= F.expr("(m - 1) div 2 + 1"))
    gold = truth.select("row", "label").distinct()
    total = gold.agg(F.count("*").alias("gold"))
    hits = kept.join(gold.withColumn("y", F.lit(1)), ["row", "label"], "left").groupBy("left_out").agg(F.sum(F.coalesce("y", F.lit(0))).alias("tp"), F.count("*").alias("pred"))
    full = names.join(hits, "left_out", "left").fillna(0, ["tp", "pred"]).crossJoin(F.broadcast(total))
    return full.select("left_out", f1(F.col("tp"), F.col("pred") - F.col("tp"), F.col("gold") - F.col("tp")).alias("micro_f1"))


def max_probability_ood(scores: DataFrame, threshold: float | Column | None = None, by: By = ()) -> DataFrame:
    """(by, row, ood_score, is_ood): 1 - the row's best score; flagged strictly over the threshold."""
    out = scores.groupBy(*by, "row").agg((1 - F.max("s")).alias("ood_score"))
    return out if threshold is None else out.withColumn("is_ood", F.col("ood_score") > threshold)


def ood_threshold(scores: DataFrame, by: By = (), at: float = 0.95) -> DataFrame:
    """The validation scores' linear percentile."""
    return linear_percentile(max_probability_ood(scores, by=by), "ood_score", at, by, "threshold")


def linear_percentile(df: DataFrame, value: str, at: float, by: By = (), name: str = "percentile", bins: int = 4096) -> DataFrame:
    """(by, name): the linear percentile of a column of numbers from 0 to 1, with no group's values in one task.

    Equal values are counted first; the two values that frame the place are found by bins' totals, then within their bins.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_g{i}") for i, c in enumerate(by)] or [F.lit("").alias("_g0")]
    names = [f"_g{i}" for i in range(max(1, len(by)))]
    v = F.col(value).cast("double")
    spot = F.least(F.greatest(F.floor(F.col("_v") * bins), F.lit(0)), F.lit(bins - 1)).cast("int").alias("_b")
    each = df.where(F.col(value).isNotNull()).groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_n")).select(*by, *keys, spot, "_v", "_n")
    per = each.groupBy(*names, "_b").agg(F.sum("_n").alias("_in"))  # a row a group and bin
    down, whole = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*names)
    place = (F.sum("_in").over(whole) - 1) * F.lit(float(at))
    ends = per.select(*names, "_b", (F.sum("_in").over(down) - F.col("_in")).alias("_before"), F.sum("_in").over(down).alias("_upto"), place.alias("_place"))
    ends = ends.where((F.col("_upto") > F.floor("_place")) & (F.col("_before") <= F.ceil("_place")))
    inside = each.join(F.broadcast(ends), [*names, "_b"])
    run = inside.withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy(*names, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    holds = lambda k: F.max(F.when((F.col("_to") - F.col("_n") <= k) & (k < F.col("_to")), F.col("_v")))
    low, high = F.floor("_place"), F.ceil("_place")
    found = run.groupBy(*names).agg(*(F.first(c).alias(c) for c in by), F.first("_place").alias("_p"), holds(low).alias("_low"), holds(high).alias("_high"))
    share = F.col("_p") - F.floor("_p")
    return found.select(*by, (F.col("_low") * (1 - share) + F.col("_high") * share).alias(name))


def system_ranking(metrics: DataFrame, metric: str, by: By = (), ranked: Column | None = None) -> DataFrame:
    """Adds rank: 1 for the best value, ties share; systems for which ranked is false (ablations) have none."""
    ok = F.lit(True) if ranked is None else ranked
    w = Window.partitionBy(*by, ok).orderBy(F.desc(metric))
    return metrics.withColumn("rank", F.when(ok, F.rank().over(w)))


def member_set_problems(scores: DataFrame, members: Sequence[str]) -> DataFrame:
    """(row, problem): rows whose members are not exactly the expected ones, or whose texts or languages differ."""
    want = F.array(*(F.lit(m) for m in sorted(members)))
    per = scores.groupBy("row").agg(F.array_sort(F.collect_set("member")).alias("have"), *(F.count_distinct(c).alias(c) for c in ("text", "language") if c in scores.columns))
    problems = [F.when(F.col("have") != want, "members"), *(F.when(F.col(c) > 1, c) for c in ("text", "language") if c in scores.columns)]
    return per.select("row", F.explode(F.filter(F.array(*problems), lambda x: x.isNotNull())).alias("problem"))


def finish(selected: DataFrame, rows: DataFrame, scores: DataFrame, closed: DataFrame, ood_at: float) -> DataFrame:
    """Prediction rows: labels, hierarchy paths, closed labels, OOD score and flag, a row for each of rows.

    Labels outside the tree are an error; a row without labels has empty lists.
    """
    known = close_labels(selected.select("row", "label"), closed, strict=True)
    tree = selected.select("row", "label").join(paths(closed), "label").groupBy("row").agg(F.array_sort(F.collect_set("path")).alias("hierarchy_paths"))
    up = known.groupBy("row").agg(F.array_sort(F.collect_set("node")).alias("closed_labels"))
    out = rows.join(selected_labels(selected), "row", "left").join(tree, "row", "left").join(up, "row", "left").join(max_probability_ood(scores, ood_at), "row", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"labels": F.coalesce("labels", F.array().cast("array<struct<label:string,score:double>>")), "hierarchy_paths": F.coalesce("hierarchy_paths", F.array().cast("array<array<string>>")), "closed_labels": F.coalesce("closed_labels", none)})


def vote_fraction(voted: DataFrame, members: int) -> DataFrame:
    return voted.withColumn("fraction", ratio("votes", F.lit(members)))
