"""Queries whose work is bounded in memory and shuffle, against plain formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora import catalog
from arbora.operators import hierarchy, joins, models, split


def test_sparse_top(spark, monkeypatch):
    """All pairs, in several blocks of queries and with equal scores, and no join of pairs in the plan."""
    monkeypatch.setattr(joins, "SPARSE_BLOCK", 12)
    w = spark.range(60).select(F.col("id").alias("row"), F.explode(F.sequence(F.col("id") % 5, F.col("id") % 5 + 2)).alias("n")).select("row", F.concat(F.lit("t"), F.col("n")).alias("term"), (1.0 / (1 + F.col("row") % 3)).alias("w"))
    q, d = w.where("row % 20 = 0").withColumnRenamed("row", "query"), w.withColumnRenamed("row", "doc")
    want = joins.best_by_rank(joins.sparse_similarity(q, d).where("doc <> query").withColumn("sim", F.round("sim", 9)), 7)
    got = joins.sparse_top(q, d, 7)
    assert sorted(map(tuple, got.select("query", "doc", "sim", "rank").collect())) == sorted(map(tuple, want.select("query", "doc", "sim", "rank").collect()))
    assert joins.sparse_top(q.where("false"), d).count() == 0 and joins.sparse_top(q, d.where("false")).count() == 0


def test_sparse_queries_join_no_pairs(spark, sf):
    for name in ("sparse_knn", "hybrid_fusion", "hybrid_votes"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "wq" not in plan, name


def test_stratified_split_streams(spark):
    """The sequential task takes its groups batch by batch, in the order of two spilling sorts, with the result it had as one frame."""
    rows = spark.range(3000).select(F.col("id"), F.filter(F.array(*(F.when(F.col("id") % k == 0, F.lit(f"l{k}")) for k in (2, 3, 7, 50))), lambda x: x.isNotNull()).alias("labels"), (F.col("id") * 7919 % 3000).alias("ord"))
    made = split.stratified_split(rows)
    assert [r["count"] for r in made.groupBy("split").count().orderBy("split").collect()] == split.capacities(3000, (0.7, 0.15, 0.15))
    assert "MapInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    whole = [tuple(r) for r in made.select("id", "split").orderBy("id").collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        assert [tuple(r) for r in split.stratified_split(rows).select("id", "split").orderBy("id").collect()] == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_vectors_are_made_where_a_text_lies(spark):
    """bags, totals and vectors against terms, vocabulary and tfidf, rows of one id and of none included; no term is shuffled."""
    docs = spark.createDataFrame([(0, "The cat the cat x"), (1, "a cat sat"), (2, None), (3, ""), (1, "sat the"), (None, "the dog"), (None, "dog cat")], "row int, text string")
    tf = models.terms(docs, 1)
    for d, want in ((docs, tf), (docs.where("row <> 1"), models.terms(docs.where("row <> 1"), 1))):
        found = models.bags(d)
        vocab, same = models.vocabulary(want, 2, 10), models.most_counted(models.term_totals(found), 2, 10)
        assert sorted(map(tuple, same.collect())) == sorted(map(tuple, vocab.collect()))
        plain = lambda w: sorted((r["row"], r["term"], round(r["w"], 9)) for r in w.collect())
        assert plain(models.tfidf_vectors(found, vocab, 5).long()) == plain(models.tfidf(want, vocab, 5))
    one = models.tfidf_vectors(models.bags(docs.where("row <> 1")), vocab, 5)
    assert "Aggregate" not in one.rows._jdf.queryExecution().optimizedPlan().toString()


def test_linear_model_is_fitted_in_passes(spark, monkeypatch):
    """Coefficients and sigmoids as one plain descent a label gives them, with labels in turns and small pieces; no row meets a label in a join."""
    monkeypatch.setattr(models, "MODEL_BLOCK", 8)
    rng = np.random.default_rng(0)
    x = np.where(rng.random((40, 4)) < 0.6, rng.random((40, 4)), 0)
    x[:, 0] = 1
    y = {"p": x[:, 1] > 0.3, "q": x[:, 2] > 0.5, "none": np.zeros(40, bool)}
    fold = np.arange(40) % 3
    w = spark.createDataFrame([(i, f"t{j}", float(x[i, j])) for i in range(40) for j in range(4) if x[i, j]], "row int, term string, w double")
    truth = spark.createDataFrame([(i, k) for k, v in y.items() for i in range(40) if v[i]] + [(99, "none")], "row int, label string")
    model = models.fit_linear(w, truth, spark.createDataFrame([(i, int(f)) for i, f in enumerate(fold)], "row int, fold int"), steps=20)
    got = {(r["label"], r["fold"]): r for r in model.collect()}
    assert set(got) == {(k, f) for k in "pq" for f in range(3)}
    for (k, f), r in got.items():
        use, s = fold != f, np.where(y[k], 1.0, -1.0)
        c, b, vc, vb = np.zeros(4), 0.0, np.zeros(4), 0.0
        for _ in range(20):
            g = np.where(use, -2 * s * np.maximum(0, 1 - s * (x @ c + b)), 0)
            vc, vb = 0.9 * vc - (c + x.T @ g) / (2 * use.sum() + 1), 0.9 * vb - g.sum() / (2 * use.sum() + 1)
            c, b = c + vc, b + vb
        assert [r["coef"][f"t{j}"] for j in range(4)] == pytest.approx(c.tolist()) and r["bias"] == pytest.approx(b)
        z, pos = (x @ c + b)[~use], y[k][~use]
        off = 1 / (1 + np.exp(-(r["a"] * z + r["b"]))) - np.where(pos, (pos.sum() + 1) / (pos.sum() + 2), 1 / ((~pos).sum() + 2))
        assert abs((off * z).sum()) < 1e-4 and abs(off.sum()) < 1e-4
    plan = models.score_linear(w, model)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (row" not in plan and "fold" not in plan


def test_naive_bayes_scores_are_made_where_a_text_lies(spark, sf):
    made = catalog.queries()["naive_bayes_scores"](spark, sf)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_coverage_is_counted_as_a_stream(spark):
    """Counts by hand, with projects over batches, repeated, without codes and without an id; no node meets projects in a join by its name."""
    nodes = spark.createDataFrame([("/a", True, False), ("/a/b", False, True), ("/c", True, True)], "id string, is_root boolean, is_direct_supported boolean")
    assigned = spark.createDataFrame([(1, "/a/b"), (1, "/a/b/x"), (1, "/a/b/x"), (2, "/c"), (3, "/d/e"), (9, "/c"), (None, "/c")], "pid int, code string")
    projects = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, "b"), (None, "b")], "pid int, split string")
    stored = spark.createDataFrame([(1, "/a/b"), (2, "/c"), (2, "/z")], "pid int, label string")
    direct = spark.createDataFrame([(2, "/c")], "pid int, label string")
    want = {"a": (3, 1, 1, 1, 1, 1, 1, 1, 1, 2), "b": (3, 1, 1, 0, 0, 0, 0, 0, 1, 2), "all": (6, 2, 2, 1, 1, 1, 1, 1, 2, 4)}
    for rows in ("1", "3", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        made = hierarchy.coverage_counts(projects, assigned, nodes, stored, direct)
        assert {r["split"]: tuple(r)[1:] for r in made.collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "Join LeftOuter" not in plan


def test_naive_bayes_labels_go_with_their_texts(spark, sf):
    """Sums of labels that came with the texts are those of a join, for repeated ids, null ids, null labels and no terms too; vectors meet no table."""
    docs = spark.createDataFrame([(1, "aa bb bb", "x"), (2, "aa cc", None), (3, "bb", "x"), (3, "cc cc", "y"), (3, "aa", None), (4, "", "y"), (None, "aa bb", "x"), (5, None, "z"), (6, "aa", "y")], "row int, text string, label string")
    truth = docs.select("row", "label")
    got = []
    for label in ("label", None):
        found = models.bags(docs, label=label)
        v = models.tfidf_vectors(found, models.most_counted(models.term_totals(found), 1), 9)
        got.append({(r["label"], r["term"]): pytest.approx(r["sum"]) for r in models.label_sums(v, truth).collect()})
    assert got[0] == {k: x.expected for k, x in got[1].items()} and {k[0] for k in got[0]} == {None, "x", "y"}
    rows = catalog._vectors(spark, sf, "lang").rows
    assert rows.columns[3:] == ["labels"] and "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_top_meets_all_pairs(spark, sf, monkeypatch):
    """Every pair, by brute force: with copies, ties, few shared terms, values under 0 and out of single precision, in small blocks; vectors are not taken apart."""
    monkeypatch.setattr(joins, "SPARSE_BLOCK", 400)
    monkeypatch.setattr(joins, "GATHERED", 50)
    rng = np.random.default_rng(1)
    x = np.where(rng.random((240, 12)) < 0.3, rng.integers(1, 4, (240, 12)) / 4.0, 0)
    x[40:90], x[100], x[60:240:20] = x[40], 0, x[60]
    for change in (lambda x: x, lambda x: np.where(rng.random(x.shape) < 0.2, -x, x), lambda x: x * 2.0 ** rng.integers(-12, 60, (240, 1))):
        made = change(x)
        rows = spark.createDataFrame([(i, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(made)], "doc long, at array<int>, w array<double>").repartition(3)
        got = joins.vectors_top(rows.where("doc % 20 = 0").withColumnRenamed("doc", "query"), rows, 12, 5)
        want = []
        for q in range(0, 240, 20):
            s = np.round(made @ made[q], 9)
            best = [i for i in np.lexsort((np.arange(240), -s)) if i != q and s[i] > 0][:5]
            want += [(q, int(i), rank + 1) for rank, i in enumerate(best)]
        assert sorted(tuple(r) for r in got.select("query", "doc", "rank").collect()) == sorted(want)
    plan = catalog.queries()["sparse_knn"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "explode" not in plan


def test_dense_top_keeps_k_rows_a_task(spark, monkeypatch):
    """All pairs by brute force, equal vectors in the order of doc; before the ranks a query has at most k rows of each task, however many batches that reads."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 6))
    v[50:80], v[7] = v[50], 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc long, v array<double>")
    kept = []
    plain = joins.best_by_rank
    monkeypatch.setattr(joins, "best_by_rank", lambda sims, k: kept.append(sims) or plain(sims, k))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = sorted((r["query"], r["rank"], r["doc"]) for r in joins.dense_top(rows.where("doc % 20 = 0 or doc = 7").withColumnRenamed("doc", "query"), rows, 5).collect())
        most = max(r["count"] for r in kept[0].groupBy("query", F.spark_partition_id().alias("task")).count().collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(n > 0, n, 1)
    want = []
    for q in [*range(0, 300, 20)]:
        s = np.einsum("ij,j->i", u, u[q])
        want += [(q, rank + 1, int(i)) for rank, i in enumerate([i for i in np.lexsort((np.arange(300), -np.round(s, 12))) if s[i] > 0][:5])]
    assert got == sorted(want) and most <= 5


def test_stratified_split_sorts_in_ranges(spark):
    """The plain greedy choice row by row, for ids, groups of several rows, null ids and null labels; the one task sorts batches' numbers and no groups."""
    import random

    rng = random.Random(3)
    data = [(None if i % 97 == 5 else i, f"g{rng.randrange(90)}" if i % 9 else None, rng.choice([None, [], ["a"], ["b", "a", "b"], ["c", None], ["c", "d", "a"], ["e"]]), rng.random()) for i in range(400)]
    rows = spark.createDataFrame(data, "id int, g string, labels array<string>, ord double").repartition(4)

    def plain(at):
        own = {}
        for row in sorted(data, key=lambda r: r[3]):
            size, names = own.get(row[at], (0, set()))
            own[row[at]] = size + 1, names | {x for x in row[2] or [] if x is not None}
        counts = {k: sum(n for n, names in own.values() if k in names) for k in "abcde"}
        room, share, drawn = split.capacities(400, (0.7, 0.15, 0.15)), (0.7, 0.15, 0.15), random.Random(42)
        full, target, found = list(room), [{k: n * r for k, n in counts.items()} for r in (0.7, 0.15, 0.15)], {}
        keyed = [(-len(names), min((counts[k] for k in names), default=0), drawn.random(), i, g) for i, (g, (n, names)) in enumerate(own.items())]
        for *_, g in sorted(keyed, key=lambda x: x[:4]):
            size, names = own[g][0], sorted(own[g][1])
            able = [s for s in range(3) if room[s] >= size] or [s for s in range(3) if room[s] > 0] or [0, 1, 2]
            best = max(able, key=lambda s: (sum(target[s][k] / max(counts[k] * share[s], 0.1) for k in names) / len(names) if names else 0.0, room[s] / full[s], -s))
            room[best] -= size
            for k in names:
                target[best][k] -= size
            found[g] = best
        return found

    for at, group in ((0, None), (1, "g")):
        want = plain(at)
        made = split.stratified_split(rows, group=group)
        assert sorted((r["ord"], r["split"]) for r in made.collect()) == sorted((r[3], want[r[at]]) for r in data)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "rangepartitioning(_few" in plan and "Sort [p#" in plan


def test_neighbour_votes_search_once(spark):
    """Shares by hand, a neighbour without a label in the mass; what the search made is read once."""
    fused = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.25), (1, 12, 0.25), (2, 12, 0.5)], "query long, doc long, fused double").mapInArrow(lambda batches: batches, "query long, doc long, fused double")
    labels = spark.createDataFrame([(10, "a"), (10, "a"), (11, "b"), (11, "a")], "doc long, label string")
    made = models.neighbour_votes(fused, labels, spark.createDataFrame([(1,), (2,), (3,)], "query long"))
    assert {(r["query"], r["label"]): r["s"] for r in made.collect()} == {(1, "a"): 0.75, (1, "b"): 0.25, (2, "a"): 0.0, (2, "b"): 0.0, (3, "a"): 0.0, (3, "b"): 0.0}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
