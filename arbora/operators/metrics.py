"""Metrics over one cell table.

A cell has group columns (by), row, label, and what a metric needs of y (gold 0/1), p (predicted 0/1) and
s (score). Cells where both y and p are 0 may be left out wherever only counts matter; label and row
dimensions then bring the zeros back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import f1, ratio

By = Sequence[str]


def joined_cells(truth: DataFrame, predicted: DataFrame, systems: DataFrame | None = None, by: By = ()) -> DataFrame:
    """Sparse cells from gold (row, label) and predictions (by, row, label)."""
    gold = truth.select("row", "label").distinct().withColumn("y", F.lit(1))
    if by:
        gold = gold.crossJoin(F.broadcast(systems.select(*by).distinct()))  # systems: a handful of names
    found = predicted.select(*by, "row", "label").distinct().withColumn("p", F.lit(1))
    return gold.join(found, [*by, "row", "label"], "full_outer").fillna(0, ["y", "p"])


def counts(cells: DataFrame, by: By) -> DataFrame:
    """tp, fp, fn of each group; cells may be counted already (by, tp, fp, fn)."""
    if {"tp", "fp", "fn"} <= set(cells.columns):
        return cells.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    y, p = F.col("y") == 1, F.col("p") == 1
    return cells.groupBy(*by).agg(n(y & p)("tp"), n(~y & p)("fp"), n(y & ~p)("fn"))


def flat_metrics(cells: DataFrame, labels: DataFrame, by: By = ()) -> DataFrame:
    """Micro and macro precision, recall and F1; macro is over every label of labels (label)."""
    per = counts(cells, [*by, "label"])
    dims = labels.select("label").distinct()
    if by:
        dims = cells.select(*by).distinct().crossJoin(F.broadcast(dims))
    full = dims.join(per, [*by, "label"], "left").fillna(0, ["tp", "fp", "fn"])
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    each = lambda e: F.avg(e)
    t, a, b = F.col("tp"), F.col("fp"), F.col("fn")
    return full.groupBy(*by).agg(
        ratio(tp, tp + fp).alias("micro_precision"), ratio(tp, tp + fn).alias("micro_recall"), f1(tp, fp, fn).alias("micro_f1"),
        each(ratio(t, t + a)).alias("macro_precision"), each(ratio(t, t + b)).alias("macro_recall"), each(f1(t, a, b)).alias("macro_f1"),
    )


def per_row(cells: DataFrame, rows: DataFrame, by: By = ()) -> DataFrame:
    """tp, fp, fn of each row of rows (row), rows without cells included."""
    dims = rows.select("row").distinct()
    if by:
        dims = dims.crossJoin(F.broadcast(cells.select(*by).distinct()))
    return dims.join(counts(cells, [*by, "row"]), [*by, "row"], "left").fillna(0, ["tp", "fp", "fn"])


def document_metrics(cells: DataFrame, rows: DataFrame, by: By = (), empty: float = 0.0) -> DataFrame:
    """Mean Jaccard and F1 of rows, predicted and true labels, subset accuracy, share of empty predictions.

    empty is the Jaccard of a row with no gold and no predicted label.
    """
    r = per_row(cells, rows, by)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    jaccard = F.when(tp + fp + fn == 0, F.lit(float(empty))).otherwise(ratio(tp, tp + fp + fn))
    return r.groupBy(*by).agg(
        F.avg(jaccard).alias("jaccard"), F.avg(f1(tp, fp, fn)).alias("document_f1"), F.avg(tp + fp).alias("mean_predicted_labels"), F.avg(tp + fn).alias("mean_true_labels"),
        F.avg(F.when(fp + fn == 0, 1.0).otherwise(0.0)).alias("subset_accuracy"), F.avg(F.when(tp + fp == 0, 1.0).otherwise(0.0)).alias("empty_rate"),
    )


def label_distribution(truth: DataFrame, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Thirteen statistics of gold labels (row, label) over all rows and labels."""
    n_rows = rows.select("row").distinct().agg(F.count("*").alias("n"))
    sizes = rows.select("row").distinct().join(truth.groupBy("row").agg(F.count_distinct("label").alias("k")), "row", "left").agg(
        F.avg(F.coalesce("k", F.lit(0))).alias("mean_labels_per_record"), F.percentile(F.coalesce("k", F.lit(0)), F.lit(0.5)).alias("median_labels_per_record")
    )
    support = labels.select("label").distinct().join(truth.groupBy("label").agg(F.count_distinct("row").alias("c")), "label", "left").fillna(0, ["c"]).crossJoin(F.broadcast(n_rows))
    ranked = support.withColumn("prevalence", ratio("c", "n")).withColumn("k", F.row_number().over(Window.orderBy(F.desc("c"), "label"))).withColumn("l", F.count("*").over(Window.partitionBy()))
    top = F.sum(F.when(F.col("k") <= F.ceil(F.lit(0.1) * F.col("l")), F.col("c")).otherwise(0))
    seen = F.when(F.col("c") > 0, F.col("prevalence"))
    stats = ranked.agg(
        F.max("n").alias("n_records"), F.count("*").alias("n_labels"), F.min("prevalence").alias("min_prevalence"), F.percentile("prevalence", F.lit(0.5)).alias("median_prevalence"), F.max("prevalence").alias("max_prevalence"),
        F.count_if(F.col("prevalence") < 0.01).alias("rare_labels"), ratio(F.count_if(F.col("prevalence") < 0.01), F.count("*")).alias("rare_label_share"), ratio(top, F.sum("c")).alias("top_decile_positive_share"),
        F.try_divide(F.max(seen), F.min(seen)).alias("prevalence_ratio"), F.count_if(F.col("c") == 0).alias("zero_positive_labels"), (1 - F.avg("prevalence")).alias("all_negative_accuracy"),
    )
    return stats.crossJoin(sizes)


def ranked_cells(cells: DataFrame, by: By = ()) -> DataFrame:
    """Adds k: a cell's rank in its row by score, ties by label."""
    return cells.withColumn("k", F.row_number().over(Window.partitionBy(*by, "row").orderBy(F.desc("s"), "label")))


def ranking_metrics(cells: DataFrame, by: By = (), ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """P@k (k at most the labels), R-precision and nDCG@5 from dense cells with y and s."""
    r = ranked_cells(cells, by)
    y, k = F.col("y"), F.col("k")
    gain = lambda rank: 1 / F.log2(rank + F.lit(1.0))
    per = r.groupBy(*by, "row").agg(
        F.count("*").alias("l"), F.sum("y").alias("n"), *(F.sum(F.when(k <= j, y).otherwise(0)).alias(f"h{j}") for j in ks),
        F.sum(F.when(k <= 5, y * gain(k)).otherwise(0.0)).alias("dcg"), F.collect_list(F.when(y == 1, k)).alias("hits"),
    )
    ideal = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda i: i <= F.least("n", "l")), F.lit(0.0), lambda a, i: a + gain(i))
    within = F.size(F.filter("hits", lambda i: i <= F.col("n")))
    return per.groupBy(*by).agg(*(F.avg(ratio(F.col(f"h{j}"), F.least(F.lit(j), "l"))).alias(f"p_at_{j}") for j in ks), F.avg(ratio(within, "n")).alias("r_precision"), F.avg(ratio("dcg", ideal)).alias("ndcg_at_5"))


def bin_of(score: Column, bins: int) -> Column:
    return F.least(F.floor(score * bins).cast("int"), F.lit(bins - 1))


def _ece(cells: DataFrame, by: By, bins: int, name: str) -> DataFrame:
    per = cells.groupBy(*by, bin_of(F.col("s"), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("s").alias("s"))
    return per.groupBy(*by).agg(ratio(F.sum(F.abs(F.col("y") - F.col("s"))), F.sum("n")).alias(name))


def calibration_metrics(cells: DataFrame, by: By = (), bins: int = 10) -> DataFrame:
    """ECE and Brier over all cells, ECE and accuracy of each row's first label."""
    top = ranked_cells(cells, by).where("k = 1")
    pooled = _ece(cells, by, bins, "ece")
    brier = cells.groupBy(*by).agg(F.avg((F.col("s") - F.col("y")) ** 2).alias("brier"))
    first = _ece(top, by, bins, "top1_ece")
    accuracy = top.groupBy(*by).agg(F.avg("y").alias("top1_accuracy"))
    out = pooled
    for part in (brier, first, accuracy):
        out = out.join(part, list(by)) if by else out.crossJoin(part)  # one row each
    return out


def reliability_table(cells: DataFrame, by: By = (), bins: int = 10, all_bins: bool = True) -> DataFrame:
    """(bin, low, high, n, confidence, accuracy); all_bins keeps empty bins with null means."""
    per = cells.groupBy(*by, bin_of(F.col("s"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("s").alias("confidence"), F.avg("y").alias("accuracy"))
    if all_bins:
        dims = cells.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        if by:
            dims = cells.select(*by).distinct().crossJoin(F.broadcast(dims))
        per = dims.join(per, [*by, "bin"], "left").fillna(0, ["n"])
    return per.select(*by, "bin", (F.col("bin") / F.lit(float(bins))).alias("low"), ((F.col("bin") + 1) / F.lit(float(bins))).alias("high"), "n", "confidence", "accuracy")


def top_reliability(cells: DataFrame, by: By = (), bins: int = 10) -> DataFrame:
    """Reliability of each row's first label, bins that are not empty only."""
    return reliability_table(ranked_cells(cells, by).where("k = 1"), by, bins, all_bins=False)


def _average_precision(cells: DataFrame, keys: By) -> DataFrame:
    return precision_of_steps(cells.groupBy(*keys, "s").agg(F.sum("y").alias("y"), F.count("*").alias("n")), keys)


def precision_of_steps(steps: DataFrame, keys: By) -> DataFrame:
    """(keys, ap) from gold and all cells of each score (keys, s, y, n)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumns({"tp": F.sum("y").over(w), "all": F.sum("n").over(w)})
    return run.groupBy(*keys).agg(ratio(F.sum(F.col("y") * ratio("tp", "all")), F.sum("y")).alias("ap"))


def average_precision(cells: DataFrame, by: By = (), places: int | None = None) -> DataFrame:
    """Micro average precision, and the mean over rows that have a gold label; with places, scores are rounded first."""
    near = cells if places is None else cells.withColumn("s", F.round("s", places))
    micro = _average_precision(near, by).withColumnRenamed("ap", "micro_ap")
    gold = cells.groupBy(*by, "row").agg(F.sum("y").alias("g")).where("g > 0").drop("g")
    rows = _average_precision(near.join(gold, [*by, "row"], "left_semi"), [*by, "row"])
    mean = rows.groupBy(*by).agg(F.avg("ap").alias("samples_ap"))
    return micro.join(mean, list(by)) if by else micro.crossJoin(mean)


def ood_metrics(scores: DataFrame, by: By = (), weight: str | None = None) -> DataFrame:
    """AUROC (ties count half) and the least FPR with TPR >= 0.95, from (by, s, is_ood); weights optional."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    steps = scores.groupBy(*by, "s").agg(F.sum(F.when(F.col("is_ood"), w).otherwise(0.0)).alias("o"), F.sum(F.when(F.col("is_ood"), 0.0).otherwise(w)).alias("i"))
    down = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    run = steps.withColumns({"co": F.sum("o").over(down), "ci": F.sum("i").over(down), "to": F.sum("o").over(whole), "ti": F.sum("i").over(whole)})
    wins = F.col("o") * (F.col("ti") - F.col("ci") + F.col("i") / 2)
    enough = ratio("co", "to") >= 0.95
    return run.groupBy(*by).agg(ratio(F.sum(wins), F.max("to") * F.max("ti")).alias("auroc"), F.min(F.when(enough, ratio("ci", "ti"))).alias("fpr_at_95_tpr"))


def root_confusion(truth: DataFrame, predicted: DataFrame, roots: DataFrame) -> DataFrame:
    """(gold_root, root, rate): on the diagonal the recall of a root; elsewhere how often root is predicted, not gold, given gold_root.

    truth and predicted are (row, label) restricted to roots (label).
    """
    g = truth.select("row", F.col("label").alias("gold_root")).distinct()
    p = predicted.select("row", F.col("label").alias("root")).distinct()
    false = p.join(truth.select("row", F.col("label").alias("root")), ["row", "root"], "left_anti")
    right = p.join(g, (p["row"] == g["row"]) & (p["root"] == g["gold_root"])).select("gold_root", "root")
    wrong = g.join(false, "row").select("gold_root", "root")
    hits = right.unionByName(wrong).groupBy("gold_root", "root").agg(F.count("*").alias("c"))
    support = g.groupBy("gold_root").agg(F.count("*").alias("support"))
    return root_rates(hits, support, roots)


def root_rates(hits: DataFrame, support: DataFrame, roots: DataFrame) -> DataFrame:
    """(gold_root, root, rate) from hits (gold_root, root, c) and support (gold_root, support)."""
    dims = roots.select(F.col("label").alias("gold_root")).crossJoin(F.broadcast(roots.select(F.col("label").alias("root"))))  # roots of one tree
    return dims.join(support, "gold_root", "left").join(hits, ["gold_root", "root"], "left").select("gold_root", "root", ratio(F.coalesce("c", F.lit(0)), F.coalesce("support", F.lit(0))).alias("rate"))


def depth_f1(cells: DataFrame, depths: DataFrame, rows: DataFrame, by: By = ()) -> DataFrame:
    """(depth, micro_f1) of closed cells; depths is (label, depth).

    A depth with one node reads as a two-class task, in which right absences count as well: its value is then accuracy.
    """
    nodes = depths.groupBy("depth").agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(rows.select("row").distinct().agg(F.count("*").alias("n"))))
    per = counts(cells.join(F.broadcast(depths), "label"), [*by, "depth"])
    dims = nodes if not by else nodes.crossJoin(F.broadcast(cells.select(*by).distinct()))
    met = dims.join(per, [*by, "depth"], "left").fillna(0, ["tp", "fp", "fn"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return met.select(*by, "depth", F.when(F.col("nodes") == 1, ratio(F.col("n") - fp - fn, "n")).otherwise(f1(tp, fp, fn)).alias("micro_f1"))


def f1_by_group(cells: DataFrame, groups: DataFrame, on: str, group: str, by: By = ()) -> DataFrame:
    """Micro-F1 of each group of rows or labels (on, group); a group without rows or labels has null."""
    named = groups.where(F.col(on).isNotNull()).select(on, group).distinct()
    per = counts(cells.join(named, on), [*by, group])
    dims = groups.select(group).distinct()
    if by:
        dims = dims.crossJoin(F.broadcast(cells.select(*by).distinct()))
    met = dims.join(per, [*by, group], "left").join(named.groupBy(group).agg(F.count("*").alias("members")), group, "left")
    c = lambda x: F.coalesce(x, F.lit(0))
    return met.select(*by, group, F.when(F.col("members") > 0, f1(c("tp"), c("fp"), c("fn"))).alias("micro_f1"))


def frequency_bucket(support: Column) -> Column:
    return F.when(support < 70, "<70").when(support < 200, "70-199").otherwise(">=200")


def gold_count_bucket(n: Column) -> Column:
    return F.when(n >= 4, "4+").otherwise(n.cast("string"))


def top_errors(cells: DataFrame, by: By = (), most: int = 10) -> DataFrame:
    """(kind, label, errors, total, k): the most labels with most missed gold cells, and with most false ones.

    total is the label's gold cells for missed, its predicted cells for false.
    """
    per = counts(cells, [*by, "label"]).select(*by, "label", F.explode(F.array(F.struct(F.lit("missed").alias("kind"), F.col("fn").alias("errors"), (F.col("tp") + F.col("fn")).alias("total")), F.struct(F.lit("false").alias("kind"), F.col("fp").alias("errors"), (F.col("tp") + F.col("fp")).alias("total")))).alias("e"))
    flat = per.select(*by, "e.kind", "label", "e.errors", "e.total").where("errors > 0")
    return flat.withColumn("k", F.row_number().over(Window.partitionBy(*by, "kind").orderBy(F.desc("errors"), "label"))).where(F.col("k") <= most)


def flag_rates(flags: DataFrame, checks: Sequence[str], group: str, examples: int = 5) -> DataFrame:
    """(group, check, records, flagged, rate, examples): per group and `all`, first ids in order (ord, id, flags)."""
    long = flags.select(group, "ord", "id", F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("hit")) for c in checks))).alias("f")).select(group, "ord", "id", "f.check", "f.hit")
    first = long.where("hit").withColumn("k", F.row_number().over(Window.partitionBy(group, "check").orderBy("ord"))).where(F.col("k") <= examples).groupBy(group, "check").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("examples"))
    known = long.withColumn(group, F.coalesce(group, F.lit("")))  # a null group is the blank one, and not `all`
    first = first.withColumn(group, F.coalesce(group, F.lit("")))
    rates = known.rollup("check", group).agg(F.count("*").alias("records"), F.count_if("hit").alias("flagged"), F.grouping(group).alias("_all")).where("check is not null").withColumn(group, F.when(F.col("_all") == 1, "all").otherwise(F.col(group))).drop("_all")
    return rates.join(first, [group, "check"], "left").select(group, "check", "records", "flagged", ratio("flagged", "records").alias("rate"), "examples")


def summary_statistics(df: DataFrame, value: str, cuts: Sequence[float] = (), by: By = ()) -> DataFrame:
    """Mean, quartiles (linear), ends and the shares below cuts."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.25)).alias("p25"), F.percentile(v, F.lit(0.5)).alias("p50"), F.percentile(v, F.lit(0.75)).alias("p75"), F.min(v).alias("min"), F.max(v).alias("max"),
        *(F.avg(F.when(v < c, 1.0).otherwise(0.0)).alias(f"below_{c:g}".replace(".", "_")) for c in cuts),
    )


def language_counts(df: DataFrame, detected: str, expected: Column, group: str) -> DataFrame:
    """(group, records, detected as a map, mismatches), and `all`."""
    per = df.groupBy(group, detected).agg(F.count("*").alias("n"), F.count_if(F.col(detected) != expected).alias("off"))
    every = per.unionByName(per.withColumn(group, F.lit("all"))).groupBy(group, detected).agg(F.sum("n").alias("n"), F.sum("off").alias("off"))
    return every.groupBy(group).agg(F.sum("n").alias("records"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(detected, "n")))).alias("detected"), F.sum("off").alias("mismatches"))
