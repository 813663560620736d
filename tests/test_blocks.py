"""Cells counted a block at a time: hashes and sums against plain formulas, and no dense cell in a plan."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora import catalog
from arbora.functions.digests import md5_heads
from arbora.operators import blocks, decide, metrics

#: Queries whose cells are counted where a row lies.
COUNTED: list[str] = [
    "closed_vote",
    "depth_f1",
    "hierarchical_metrics",
    "root_confusion",
    "soft_vote",
    "weighted_soft_vote",
    "closure_effect",
    "tune_threshold",
    "ood_threshold",
    "top_errors",
    "ranking_metrics",
    "calibration_metrics",
    "document_metrics",
    "system_ranking",
    "leave_one_out",
    "tune_k",
    "hard_vote",
    "flat_metrics",
    "average_precision",
    "hard_selection",
    "top_reliability",
    "tune_threshold_dense_grid",
    "ood_metrics",
    "f1_by_gold_count",
    "benchmark_protocol",
]


@pytest.mark.parametrize("name", COUNTED)
def test_no_dense_cells_in_the_plan(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan


def test_md5_heads():
    numbers, ends = np.array([0, 7, -5, 99, 123456789012]), [":a", ":/1/2/x:alpha", ":" + "y" * 70, "", ":é"]
    want = [[int(hashlib.md5(f"{n}{e}".encode()).hexdigest()[:6], 16) for e in ends] for n in numbers.tolist()]
    assert md5_heads(numbers, ends).tolist() == want
    assert md5_heads(np.array([], np.int64), ends).shape == (0, 5)


def made(spark):
    """Three rows, one without gold, with equal scores in two of them, and two members."""
    s = {1: [[0.9, 0.9, 0.1], [0.2, 0.8, 0.7]], 2: [[0.5, 0.5, 0.5], [0.75, 0.1, 0.0]], 3: [[0.0, 1.0, 0.02], [0.7, 0.7, 0.7]]}
    table = spark.createDataFrame([(1, [1]), (2, []), (3, [0, 2])], "row long, own array<int>")
    return blocks.Blocks(table, ("/a/x", "/a/y", "/b/z"), ("m", "n"), lambda rows, y: np.array([s[r] for r in rows.tolist()]))


def cells(spark, made):
    rows = made.table.collect()
    s = made.score(np.array([r["row"] for r in rows]), None)
    return spark.createDataFrame([(m, r["row"], x, int(k in r["own"]), float(s[i, j, k]), int(s[i, j, k] >= 0.7)) for i, r in enumerate(rows) for j, m in enumerate(made.members) for k, x in enumerate(made.labels)], "member string, row long, label string, y int, s double, p int")


def same(a, b):
    table = lambda d: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in sorted(a.columns)))) for r in d.collect())
    assert table(a) == table(b)


def test_blocks_agree_with_cells(spark):
    b = made(spark)
    c = cells(spark, b).cache()
    score = b.score
    first = blocks.Blocks(b.table, b.labels, ("m",), lambda rows, y: score(rows, y)[:, :1])
    one, rows = c.where("member = 'm'"), c.select("row").distinct()
    same(metrics.counts(c, ["member", "label"]), blocks.counts(b, 0.7))
    same(metrics.document_metrics(c, rows, ["member"], 1.0), blocks.document_metrics(b, 0.7, 1.0))
    same(metrics.ranking_metrics(one), blocks.ranking_metrics(first))
    same(metrics.calibration_metrics(one), blocks.calibration_metrics(first))
    same(metrics.reliability_table(one), blocks.reliability(blocks.score_bins(first)))
    same(metrics.top_reliability(one), blocks.reliability(blocks.score_bins(first, first=True)).where("n > 0"))
    same(metrics.average_precision(one, places=4), blocks.average_precision(first, 4))
    for grid, lowest in ((decide.GRID, True), (decide.DENSE_GRID, False), ((0.1, 0.1001, 0.7), True)):
        same(decide.tune_threshold(c, ["member"], grid, lowest, True), decide.best_threshold(blocks.threshold_steps(b, grid), ["member"], grid, lowest, True))
    truth, chosen = c.where("y = 1").select("row", "label").distinct(), c.where("p = 1").select("member", "row", "label")
    same(decide.tune_k(decide.votes(chosen), truth, 2), decide.best_k(blocks.vote_counts(b, 0.7).where("votes > 0"), truth.agg(F.count("*").alias("gold")), 2))
    same(decide.votes(chosen).where("votes > 1"), blocks.voted_cells(b, 0.7, 2))
    out = blocks.left_out_counts(b, 0.7).select("left_out", metrics.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("micro_f1"))
    same(decide.leave_one_out(chosen, truth, c.select("member").distinct()), out)
    soft = blocks.soft_counts(b, 0.5, [3.0, 1.0]).first()
    weights = spark.createDataFrame([("m", 3.0), ("n", 1.0)], "member string, w double")
    want = decide.soft_vote(c, 2, weights).agg(F.sum("s").alias("s"), F.count_if(F.col("s") >= 0.5).alias("n")).first()
    assert (round(soft["s"], 9), soft["n_selected"], soft["gold"]) == (round(want["s"], 9), want["n"], 3)


def test_closed_counts_and_roots(spark):
    b = made(spark)
    up = blocks.up_matrix(b.labels, [(x, x) for x in b.labels] + [("/a/x", "/a"), ("/a/y", "/a"), ("/b/z", "/b")])
    assert up[0] == ("/a", "/a/x", "/a/y", "/b", "/b/z")
    found = {(r["member"], r["label"]): (r["tp"], r["fp"], r["fn"]) for r in blocks.closed_counts(b, 0.7, up).collect()}
    assert found["m", "/a"] == (2, 0, 0) and found["m", "/b"] == (0, 0, 1) and found["n", "/a"] == (2, 1, 0) and found["n", "/b"] == (1, 1, 0)
    hits = {(r["gold_root"], r["root"]): (r["c"], r["support"]) for r in blocks.root_counts(b, 0.7, ("/a", "/b"), up).collect()}
    assert hits == {("/a", "/a"): (2, 2), ("/a", "/b"): (0, 2), ("/b", "/a"): (0, 1), ("/b", "/b"): (0, 1)}


def test_linear_percentile(spark):
    values = [0.0, 0.25, 0.25, 0.25, 0.250001, 0.9, 1.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 0.5), (None, 0.1), (None, 0.2)], "g string, v double")
    for at in (0.0, 0.3, 0.5, 0.95, 1.0):
        got = {r["g"]: r["p"] for r in decide.linear_percentile(df, "v", at, ["g"], "p").collect()}
        assert got == pytest.approx({"a": np.quantile(values, at), "b": 0.5, None: np.quantile([0.1, 0.2], at)})
    assert decide.linear_percentile(df, "v", 0.5).first()["percentile"] == pytest.approx(0.25)
