"""Text-pair quality, repetition, near-OOD partitions and closure effects."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import f1
from ..functions.text import without_space
from . import metrics


def chrf_score(hypothesis: str, reference: str, orders: int = 6, beta: float = 2.0) -> float:
    """chrF of two texts without their white space. Equal n-grams get equal numbers, order by order from those one shorter."""
    sides = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for x in (hypothesis, reference)]
    n_h = len(sides[0])
    signs = np.unique(np.concatenate(sides), return_inverse=True)[1]
    base = int(signs.max()) + 1 if len(signs) else 1
    number, precision, recall = [signs[:n_h], signs[n_h:]], [], []
    for n in range(1, orders + 1):
        if n > 1:
            made = [x[:-1] * base + s[n - 1 :] for x, s in zip(number, (signs[:n_h], signs[n_h:]), strict=True)]
            every = np.unique(np.concatenate(made), return_inverse=True)[1]
            number = [every[: len(made[0])], every[len(made[0]) :]]
        h, r = number
        if not len(h) or not len(r):
            break
        size = int(max(h.max(), r.max())) + 1
        met = int(np.minimum(np.bincount(h, minlength=size), np.bincount(r, minlength=size)).sum())
        precision.append(met / len(h))
        recall.append(met / len(r))
    if not precision:
        return 0.0
    p, q, b = sum(precision) / len(precision), sum(recall) / len(recall), beta * beta
    return 100 * (1 + b) * p * q / (b * p + q) if p + q else 0.0


def chrf(pairs: DataFrame, keys: Sequence[str], hypothesis: str, reference: str, orders: int = 6, beta: float = 2.0) -> DataFrame:
    """(keys, chrf): clipped character n-gram precision and recall on 0 to 100, averaged over the orders that both texts reach.

    A pair's n-grams are counted where the pair lies (Arrow), so nothing is shuffled. A null text is empty.
    """

    @F.pandas_udf("double")
    def score(h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([chrf_score(x, y, orders, beta) for x, y in zip(h, r, strict=True)])

    plain = lambda c: F.coalesce(without_space(c), F.lit(""))
    return pairs.select(*keys, score(plain(hypothesis), plain(reference)).alias("chrf"))


def repeated_spans(tokens: Sequence[str], least: int = 4) -> Iterator[tuple[int, int]]:
    """(n, first token) of maximal stretches in which an n-gram, n >= least, stands twice in a row; shortest n first."""
    seen: dict[str, int] = {}
    code = np.array([seen.setdefault(t, len(seen)) for t in tokens], np.int64)
    m = len(code)
    if m < 2 * least or len(seen) == m:
        return
    for n in range(least, m // 2 + 1):
        same = code[: m - n] == code[n:]
        if np.count_nonzero(same) < n:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if hi - lo >= n:
                yield from ((n, at) for at in range(lo, hi - n + 1))


def has_repeats(tokens: Column) -> Column:
    """Whether a word n-gram, n >= 4, stands twice in a row (Arrow)."""

    @F.pandas_udf("boolean")
    def repeats(x: pd.Series) -> pd.Series:
        return x.map(lambda t: bool(len(t)) and next(repeated_spans(list(t)), None) is not None)

    return repeats(tokens)


def translation_repeats(tokens: Column, source: Column) -> Column:
    """Whether a doubled n-gram of a translation is not in its source's words (Arrow)."""

    def own(t: Sequence[str], s: Sequence[str]) -> bool:
        padded = f" {' '.join(s)} "
        return any(f" {' '.join(t[at : at + 2 * n])} " not in padded for n, at in repeated_spans(t))

    @F.pandas_udf("boolean")
    def repeats(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([own(list(t), list(s)) for t, s in zip(x, y, strict=True)])

    return repeats(tokens, source)


def near_ood_partition(rows: DataFrame, shapes: DataFrame, held_out: Sequence[str]) -> DataFrame:
    """(row, part): none, only or mixed, by the roots of a row's labels; shapes is (label, root)."""
    out = F.col("root").isin(*held_out)
    met = rows.join(F.broadcast(shapes.select("label", "root")), "label").groupBy("row").agg(F.bool_and(out).alias("every"), F.bool_or(out).alias("some"))
    return met.select("row", F.when(F.col("every"), "only").when(F.col("some"), "mixed").otherwise("none").alias("part"))


def closure_effect(chosen: DataFrame, stored: DataFrame, complete: DataFrame) -> DataFrame:
    """(member, hmicro_f1_stored, hmicro_f1_complete) of closed selections (member, row, label) against two gold closures (row, label)."""
    systems = chosen.select("member").distinct()

    def against(gold: DataFrame, name: str) -> DataFrame:
        cells = metrics.joined_cells(gold, chosen, systems, ["member"])
        return metrics.counts(cells, ["member"]).select("member", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias(name))

    return against(stored, "hmicro_f1_stored").join(against(complete, "hmicro_f1_complete"), "member")


def closure_summary(effect: DataFrame) -> DataFrame:
    """One row: the largest change, and whether the members' order stays."""
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("f"), "member"))), lambda x: x["member"])
    change = F.max(F.abs(F.col("hmicro_f1_complete") - F.col("hmicro_f1_stored")))
    return effect.agg(change.alias("max_abs_hmicro_f1_change"), (order("hmicro_f1_stored") == order("hmicro_f1_complete")).alias("ranking_unchanged"))


def with_and_without(cells: DataFrame, flagged: DataFrame, labels: DataFrame, key: str = "row") -> DataFrame:
    """Micro and macro F1 of all rows, those flagged and the others (part); flagged is (row)."""
    marked = cells.join(flagged.select(key, F.lit(True).alias("hit")).distinct(), key, "left")
    parts = marked.select(*cells.columns, F.explode(F.array(F.lit("all"), F.when(F.col("hit"), "only").otherwise("without"))).alias("part"))
    return metrics.flat_metrics(parts, labels, ["part"]).select("part", "micro_f1", "macro_f1")


def canary_problems(stored: DataFrame, encoded: DataFrame, key: str = "row", tolerance: float = 5e-3) -> DataFrame:
    """(row, gap): vectors that an encoder now makes otherwise than when the index was built."""
    a, b = stored.select(key, F.col("v").alias("a")), encoded.select(key, F.col("v").alias("b"))
    gap = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return a.join(b, key, "left").select(key, gap.alias("gap")).where(F.col("gap").isNull() | (F.col("gap") > tolerance))
