"""Paired bootstrap, Holm correction and significance families.

Resampling works on sufficient counts, one row a project: a replicate is a weighted sum of them. The
NumPy mode draws multinomial weights from one generator; the hashed mode draws by hash, which SQL repeats.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import f1

By = Sequence[str]
SEED = 42
#: Replicates that one task draws.
BLOCK = 250
#: Drawn weights that a task holds at once.
HELD = 4_000_000


def holm(p_values: DataFrame, by: By = (), name: str = "name", p: str = "p_value") -> DataFrame:
    """Adds p_holm: step-down, never falling, at most 1; ties in name order."""
    w = Window.partitionBy(*by).orderBy(p, name)
    ranked = p_values.withColumns({"_k": F.row_number().over(w), "_m": F.count("*").over(Window.partitionBy(*by))})
    stepped = F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_k") + 1) * F.col(p))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("p_holm", stepped).drop("_k", "_m")


def pair_counts(cells_a: DataFrame, cells_b: DataFrame, project: str = "pair_id") -> DataFrame:
    """(project, tp_a, err_a, tp_b, err_b) of two systems' cells (project, y, p); a project missing on one side has zeros."""
    def of(cells: DataFrame, s: str) -> DataFrame:
        return cells.groupBy(project).agg(F.sum(F.col("y") * F.col("p")).alias(f"tp_{s}"), F.sum(F.abs(F.col("y") - F.col("p"))).alias(f"err_{s}"))

    return of(cells_a, "a").join(of(cells_b, "b"), project, "full_outer").fillna(0)


def drawn(draw: np.random.Generator, n: int, p: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """size multinomial draws in steps of at most HELD weights; the generator advances as in one call."""
    step = max(1, HELD // max(len(p), 1))
    for at in range(0, size, step):
        yield draw.multinomial(n, p, size=min(step, size - at))


def passed_over(draw: np.random.Generator, n: int, p: np.ndarray, size: int) -> np.random.Generator:
    """The generator after so many draws, none of which is kept."""
    for _ in drawn(draw, n, p, size):
        pass
    return draw


def hashed_draws(projects: DataFrame, replicates: int, project: str = "pair_id", seed: int = SEED) -> DataFrame:
    """(replicate, project, w): project number md5(seed:replicate:draw) mod n, n draws a replicate, counted."""
    numbered = projects.select(project).distinct().withColumn("_i", F.row_number().over(Window.orderBy(project)) - 1)  # one row a project
    n = numbered.agg(F.count("*").alias("_n"))
    draws = projects.sparkSession.range(replicates).select(F.col("id").alias("replicate")).crossJoin(F.broadcast(n)).withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    hit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("_d").cast("string"))), 1, 12), 16, 10).cast("long") % F.col("_n")
    counted = draws.groupBy("replicate", hit.alias("_i")).agg(F.count("*").alias("w"))
    return counted.join(numbered, "_i").select("replicate", project, "w")


def replicate_differences(counts: DataFrame, draws: DataFrame, project: str = "pair_id") -> DataFrame:
    """(replicate, difference): micro-F1 of a less that of b under each replicate's weights."""
    w = lambda c: F.sum(F.col("w") * F.col(c))
    f = lambda s: 2 * F.col(f"tp_{s}") / F.nullif(2 * F.col(f"tp_{s}") + F.col(f"err_{s}"), F.lit(0))
    per = draws.join(counts, project).groupBy("replicate").agg(*(w(c).alias(c) for c in ("tp_a", "err_a", "tp_b", "err_b")))
    return per.select("replicate", (F.coalesce(f("a"), F.lit(0.0)) - F.coalesce(f("b"), F.lit(0.0))).alias("difference"))


def interval(differences: DataFrame, counts: DataFrame | None = None, by: By = ()) -> DataFrame:
    """95 % percentile interval, add-one two-sided p-value and its resolution; with counts also the point values."""
    d = F.col("difference")
    b = F.count("*").cast("double")
    tail = F.least(F.count_if(d <= 0), F.count_if(d >= 0))
    out = differences.groupBy(*by).agg(
        F.percentile(d, F.lit(0.025)).alias("ci_low"), F.percentile(d, F.lit(0.975)).alias("ci_high"), F.least(F.lit(1.0), 2 * (1 + tail) / (1 + b)).alias("p_value"), (2 / (1 + b)).alias("p_resolution")
    )
    if counts is None:
        return out
    point = counts.groupBy(*by).agg(*(f1(F.sum(f"tp_{s}"), F.sum(f"err_{s}"), F.lit(0)).alias(s) for s in ("a", "b")))
    point = point.withColumn("difference", F.col("a") - F.col("b"))
    return point.join(out, list(by)) if by else point.crossJoin(out)


def paired_bootstrap(counts: DataFrame, resamples: int = 1000, project: str = "pair_id", seed: int = SEED) -> DataFrame:
    """Micro-F1 difference with one multinomial generator, so its draws are those of a single run in project order.

    counts has a row a project; these small rows are shared with all tasks, each of which skips to its
    replicates. For projects beyond a task's memory use hashed_draws.
    """
    table = counts.orderBy(project).select("tp_a", "err_a", "tp_b", "err_b").toPandas().to_numpy(float)
    rows = len(table)
    shared = counts.sparkSession.sparkContext.broadcast(table)
    starts = counts.sparkSession.range(0, resamples, BLOCK, max(1, resamples // BLOCK))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in frame["id"]:
                even, n = np.full(rows, 1 / rows), int(min(BLOCK, resamples - lo))
                draw = passed_over(np.random.default_rng(seed), rows, even, int(lo))
                s = np.concatenate([w @ shared.value for w in drawn(draw, rows, even, n)])
                f = lambda tp, err: np.divide(2 * tp, 2 * tp + err, out=np.zeros_like(tp), where=(2 * tp + err) > 0)
                yield pd.DataFrame({"replicate": np.arange(lo, lo + n), "difference": f(s[:, 0], s[:, 1]) - f(s[:, 2], s[:, 3])})

    if not rows:
        return counts.limit(0).selectExpr("0D as a", "0D as b", "0D as difference", "0D as ci_low", "0D as ci_high", "1D as p_value", "1D as p_resolution")
    return interval(starts.mapInPandas(run, "replicate long, difference double"), counts)


def macro_differences(cells: DataFrame, draws: DataFrame, labels: DataFrame, project: str = "pair_id") -> DataFrame:
    """(replicate, difference) of macro-F1 between systems a and b; cells (system, project, label, y, p) with y or p set."""
    per = cells.groupBy("system", project, "label").agg(F.sum(F.col("y") * F.col("p")).alias("tp"), F.sum(F.abs(F.col("y") - F.col("p"))).alias("err"))
    sums = draws.join(per, project).groupBy("replicate", "system", "label").agg(F.sum(F.col("w") * F.col("tp")).alias("tp"), F.sum(F.col("w") * F.col("err")).alias("err"))
    n = labels.select("label").distinct().agg(F.count("*").alias("n"))
    score = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("err"))).otherwise(0.0)
    signed = F.when(F.col("system") == "a", score).otherwise(-score)
    return sums.groupBy("replicate").agg(F.sum(signed).alias("d")).crossJoin(F.broadcast(n)).select("replicate", (F.col("d") / F.col("n")).alias("difference"))


def auroc_interval(scores: DataFrame, replicates: int = 1000, seeds: tuple[int, int] = (42, 43)) -> DataFrame:
    """(ci_low, ci_high) of AUROC, each side resampled with its own generator; scores (s, is_ood) meet as grouped counts."""
    grouped = scores.groupBy("s", "is_ood").count().orderBy("s").toPandas()
    sides = [grouped[grouped.is_ood == side] for side in (False, True)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in frame["id"]:
                n = int(min(BLOCK, replicates - lo))
                totals = [int(part["count"].sum()) for part in sides]
                shares = [part["count"].to_numpy() / total for part, total in zip(sides, totals, strict=True)]
                draws = [passed_over(np.random.default_rng(seed), total, p, int(lo)) for seed, total, p in zip(seeds, totals, shares, strict=True)]
                s_id, s_ood = (p["s"].to_numpy() for p in sides)
                left, right = np.searchsorted(s_id, s_ood, "left"), np.searchsorted(s_id, s_ood, "right")
                wins = np.zeros(n)
                # a replicate at a time: a side's draws are read in order, whatever the steps
                each = [(w for block in drawn(draw, total, p, n) for w in block) for draw, total, p in zip(draws, totals, shares, strict=True)]
                for k, (of_id, of_ood) in enumerate(zip(*each, strict=True)):
                    cum = np.concatenate([[0.0], np.cumsum(of_id, dtype=float)])
                    wins[k] = (of_ood * (cum[left] + cum[right]) / 2).sum()
                yield pd.DataFrame({"auroc": wins / (totals[0] * totals[1])})

    starts = scores.sparkSession.range(0, replicates, BLOCK, max(1, replicates // BLOCK))
    return starts.mapInPandas(run, "auroc double").agg(F.percentile("auroc", F.lit(0.025)).alias("ci_low"), F.percentile("auroc", F.lit(0.975)).alias("ci_high"))


def member_pairs(members: DataFrame, left: str, right: str) -> DataFrame:
    """(a, b): every member of kind left with every one of kind right."""
    names = lambda kind, to: members.where(F.col("kind") == kind).select(F.col("member").alias(to))
    return names(left, "a").crossJoin(F.broadcast(names(right, "b")))  # a handful of members


def bootstrap_family(cells: DataFrame, pairs: DataFrame, replicates: int, family: Sequence[str] = ("family",), project: str = "pair_id", seed: int = SEED) -> DataFrame:
    """Intervals and Holm-corrected p-values of comparisons (family, name, a, b) between systems of cells.

    One set of draws serves all comparisons, so systems are compared under the same resamples.
    """
    per = cells.groupBy("system", project).agg(F.sum(F.col("y") * F.col("p")).alias("tp"), F.sum(F.abs(F.col("y") - F.col("p"))).alias("err"))
    draws = hashed_draws(per, replicates, project, seed)
    sums = draws.join(per, project).groupBy("replicate", "system").agg(F.sum(F.col("w") * F.col("tp")).alias("tp"), F.sum(F.col("w") * F.col("err")).alias("err")).withColumn("f", f1(F.col("tp"), F.col("err"), F.lit(0)))
    side = lambda s: sums.select("replicate", F.col("system").alias(s), F.col("f").alias(f"f_{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), ["b", "replicate"]).select(*family, "name", "replicate", (F.col("f_a") - F.col("f_b")).alias("difference"))
    return holm(interval(met, by=[*family, "name"]), by=family)
