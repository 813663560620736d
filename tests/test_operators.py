"""Operators on the hand-computed cases of the blueprint and their edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import audit, decide, hierarchy, joins, metrics, models, split, stats, variants
from arbora.plans import jobs
from arbora.sources import readers, sinks
from arbora.streaming.scoring import gaps, run_identity


def cells(spark, truth, predicted):
    t = spark.createDataFrame([(i, x) for i, s in enumerate(truth) for x in s], "row int, label string")
    p = spark.createDataFrame([(i, x) for i, s in enumerate(predicted) for x in s], "row int, label string")
    return metrics.joined_cells(t, p)


def names(spark, letters):
    return spark.createDataFrame([(x,) for x in letters], "label string")


def dense(spark, scores, truth, letters):
    rows = [(i, x, int(x in truth[i]), float(s)) for i, line in enumerate(scores) for x, s in zip(letters, line, strict=True)]
    return spark.createDataFrame(rows, "row int, label string, y int, s double")


def test_flat(spark):
    r = metrics.flat_metrics(cells(spark, ["ab", "a"], ["a", "ac"]), names(spark, "abc")).first()
    assert r["micro_precision"] == pytest.approx(2 / 3) and r["micro_recall"] == pytest.approx(2 / 3) and r["micro_f1"] == pytest.approx(2 / 3) and r["macro_f1"] == pytest.approx(1 / 3)
    r = metrics.flat_metrics(cells(spark, ["a", "a"], ["a", "a"]), names(spark, "abc")).first()
    assert r["micro_f1"] == 1 and r["macro_f1"] == pytest.approx(1 / 3)


def test_documents(spark):
    r = metrics.document_metrics(cells(spark, ["ab", "c"], ["a", "bc"]), spark.range(2).withColumnRenamed("id", "row")).first()
    assert r["jaccard"] == pytest.approx(0.5) and r["document_f1"] == pytest.approx(2 / 3)
    empty = cells(spark, ["a", ""], ["a", ""])
    rows = spark.range(2).withColumnRenamed("id", "row")
    assert metrics.document_metrics(empty, rows).first()["jaccard"] == 0.5
    assert metrics.document_metrics(empty, rows, empty=1.0).first()["jaccard"] == 1.0


def test_ranking(spark):
    r = metrics.ranking_metrics(dense(spark, [[0.9, 0.1, 0.8], [0.2, 0.3, 0.7]], ["ab", "c"], "abc"), ks=(1, 2)).first()
    assert (r["p_at_1"], r["p_at_2"], r["r_precision"]) == (1.0, 0.5, 0.75)


def test_calibration(spark):
    r = metrics.calibration_metrics(dense(spark, [[0.9] * 3] * 2, ["a", "b"], "abc")).first()
    assert r["ece"] == pytest.approx(0.9 - 2 / 6) and r["top1_accuracy"] == 0.5


def test_ood(spark):
    s = spark.createDataFrame([(0.1, False), (0.2, False), (0.3, False), (0.8, True), (0.9, True), (0.25, True)], "s double, is_ood boolean")
    r = metrics.ood_metrics(s).first()
    assert r["auroc"] == pytest.approx(8 / 9) and r["fpr_at_95_tpr"] == pytest.approx(1 / 3)


def test_label_distribution(spark):
    counts = [100, 50, 20, 10, 4, 2, 1, 1, 0, 0]
    truth = spark.createDataFrame([(i, str(k)) for k, n in enumerate(counts) for i in range(n)], "row int, label string")
    r = metrics.label_distribution(truth, spark.range(200).withColumnRenamed("id", "row"), names(spark, "0123456789")).first()
    assert (r["n_records"], r["n_labels"], r["rare_labels"], r["zero_positive_labels"]) == (200, 10, 4, 2)
    assert r["max_prevalence"] == 0.5 and r["prevalence_ratio"] == pytest.approx(100) and r["top_decile_positive_share"] == pytest.approx(100 / 188)


TREE = [("root", None), ("mid", "root"), ("leaf", "mid"), ("other", "root")]


def tree(spark, rows=TREE):
    return spark.createDataFrame([(i, i, p) for i, p in rows], "id string, name string, parent string")


def test_closure_and_violations(spark):
    closed = hierarchy.closure(tree(spark))
    rows = spark.createDataFrame([(0, "leaf"), (1, "other"), (2, "stray")], "row int, label string")
    got = {(r["row"], r["node"]) for r in hierarchy.close_labels(rows, closed).collect()}
    assert got == {(0, "leaf"), (0, "mid"), (0, "root"), (1, "other"), (1, "root"), (2, "stray")}
    with pytest.raises(Exception, match="not in the tree"):
        hierarchy.close_labels(rows, closed, strict=True).collect()
    full = spark.createDataFrame([(0, "leaf"), (0, "mid"), (0, "root"), (1, "other")], "row int, label string")
    assert hierarchy.violation_rate(full, tree(spark), full).first()[0] == 0.5
    assert [r["path"] for r in hierarchy.paths(closed).where("label = 'leaf'").collect()] == [["root", "mid", "leaf"]]


def test_tree_problems(spark):
    bad = tree(spark, [("a", "b"), ("b", "a"), ("c", "gone"), ("d", None)])
    got = {(r["problem"], r["node"]) for r in hierarchy.validate_tree(bad, 8).collect()}
    assert got == {("cycle", "a"), ("cycle", "b"), ("missing_parent", "c")}
    assert hierarchy.validate_tree(tree(spark), 8).isEmpty()


def test_taxonomy(spark):
    a = spark.createDataFrame([(i, "/1/2") for i in range(3)] + [(i, "/1/3") for i in range(1)] + [(9, "/1/2")] * 2, "pid int, code string")
    got = {r["id"]: r for r in hierarchy.build_taxonomy(a, 2).collect()}
    assert set(got) == {"/1", "/1/2"} and got["/1/2"]["support"] == 4 and got["/1/2"]["is_leaf"] and got["/1"]["is_root"] and not got["/1"]["is_direct_supported"]
    near = {r["code"]: r["nearest"] for r in hierarchy.nearest_supported(a, spark.createDataFrame([("/1",)], "code string")).collect()}
    assert near == {"/1/2": "/1", "/1/3": "/1"}


def test_threshold_tuners(spark):
    c = dense(spark, [[0.2, 0.25], [0.3, 0.1]], ["b", "a"], "ab")
    assert decide.tune_threshold(c, grid=(0.1, 0.22, 0.5)).first()["threshold"] == 0.22
    assert decide.tune_threshold(c, grid=(0.21, 0.22)).first()["threshold"] == 0.21
    assert decide.tune_threshold(c, grid=(0.21, 0.22), lowest=False).first()["threshold"] == 0.22


def test_votes(spark):
    s = spark.createDataFrame([("x", 0, "a"), ("y", 0, "a"), ("z", 0, "b"), ("x", 0, "b"), ("y", 0, "c")], "member string, row int, label string")
    assert {r["label"]: r["votes"] for r in decide.votes(s).collect()} == {"a": 2, "b": 2, "c": 1}
    assert decide.majority(3) == 2 and decide.majority(4) == 3
    truth = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c")], "row int, label string")
    r = decide.tune_k(decide.votes(s), truth, 3).first()
    assert (r["k"], r["micro_f1"]) == (1, 1.0)


def test_soft_vote(spark):
    s = spark.createDataFrame([("x", 0, "a", 0.2), ("x", 0, "b", 0.8), ("y", 0, "a", 0.6), ("y", 0, "b", 0.4)], "member string, row int, label string, s double")
    w = spark.createDataFrame([("x", 3.0), ("y", 1.0)], "member string, w double")
    assert {r["label"]: round(r["s"], 9) for r in decide.soft_vote(s, 2, w).collect()} == {"a": 0.3, "b": 0.7}
    with pytest.raises(Exception, match="negative"):
        decide.soft_vote(s, 2, w.withColumn("w", -F.col("w"))).collect()


def test_holm(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p_value double")
    assert {r["name"]: round(r["p_holm"], 9) for r in stats.holm(p).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_bootstrap_matches_one_generator(spark):
    rng = np.random.default_rng(0)
    table = rng.integers(0, 5, (40, 4))
    counts = spark.createDataFrame([(f"p{i:02d}", *map(int, r)) for i, r in enumerate(table)], "pair_id string, tp_a long, err_a long, tp_b long, err_b long")
    got = stats.paired_bootstrap(counts, 600).first()
    w = np.random.default_rng(42).multinomial(40, np.full(40, 1 / 40), size=600) @ table.astype(float)
    d = 2 * w[:, 0] / (2 * w[:, 0] + w[:, 1]) - 2 * w[:, 2] / (2 * w[:, 2] + w[:, 3])
    assert got["ci_low"] == pytest.approx(np.percentile(d, 2.5)) and got["ci_high"] == pytest.approx(np.percentile(d, 97.5))


def test_capacities_and_split(spark):
    assert split.capacities(10, (0.7, 0.15, 0.15)) == [7, 2, 1] and split.capacities(0, (0.7, 0.15, 0.15)) == [0, 0, 0]
    with pytest.raises(ValueError):
        split.capacities(3, (0.5, 0.1))
    rows = [(i, ["a", "b"] if i % 3 == 0 else ["c"], i, i // 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, labels array<string>, ord int, g int")
    first = {r["id"]: r["split"] for r in split.stratified_split(df).collect()}
    assert sorted(np.bincount(list(first.values()), minlength=3).tolist()) == [6, 6, 28]
    assert first == {r["id"]: r["split"] for r in split.stratified_split(df.repartition(7)).collect()}
    grouped = split.stratified_split(df, group="g").groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1")
    assert grouped.isEmpty()
    with pytest.raises(ValueError, match="repeated id"):
        split.stratified_split(df.union(df))


def test_hash_sample(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("pair_id"))
    assert split.hash_sample(df, 7).count() == 7
    with pytest.raises(ValueError):
        split.hash_sample(df.union(spark.sql("select ''")), 7)


def test_leakage_ignores_blank_keys(spark):
    df = spark.createDataFrame([("train", "1", ""), ("test", "2", ""), ("test", "1", None), ("train", "3", "f"), ("validation", "4", "f")], "split string, id string, fp string")
    assert {(r["key"], r["value"]) for r in joins.leakage(df, ["id", "fp"]).collect()} == {("id", "1"), ("fp", "f")}


def test_pair_problems(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (3, "z"), (4, "x")], "k int, v string")
    assert {(r["k"], r["problem"]) for r in joins.pair_problems(a, b, "k", ["v"]).collect()} == {(2, "repeated_left"), (2, "missing_right"), (3, "differs_v"), (4, "missing_left")}


def test_dense_top_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    v[3] = 0
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 60, 20)], "query long, v array<double>")
    d = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "doc long, v array<double>").repartition(3)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    for r in joins.dense_top(q, d, 5).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "doc"))).alias("x")).collect():
        sim = u @ u[r["query"]]
        assert [x["doc"] for x in r["x"]] == [int(i) for i in np.argsort(-sim, kind="stable")[:5] if sim[i] > 0]


def test_rank_fusion(spark):
    r = spark.createDataFrame([("a", 1, 1, 0.9), ("a", 1, 2, 0.9), ("a", 1, 3, -0.1), ("b", 1, 2, 0.5)], "retriever string, query int, doc int, sim double")
    assert {x["doc"]: round(x["fused"], 9) for x in models.fuse_ranks(r).collect()} == {1: round(1 / 61, 9), 2: round(1 / 62 + 1 / 61, 9)}


def test_naive_bayes_against_brute_force(spark):
    w = {0: {"a": 0.6, "b": 0.8}, 1: {"a": 1.0}, 2: {"c": 1.0}, 3: {"b": 0.6, "c": 0.8}}
    y = {0: "x", 1: "x", 2: "z", 3: "z"}
    wt = spark.createDataFrame([(r, t, v) for r, d in w.items() for t, v in d.items()], "row int, term string, w double")
    truth = spark.createDataFrame(list(y.items()), "row int, label string")
    extra, head = models.fit_naive_bayes(wt, truth, truth, 4)
    got = {(r["row"], r["label"]): r["s"] for r in models.score_naive_bayes(wt, wt.groupBy("term").agg(F.sum("w").alias("all")), extra, head).collect()}
    for label in "xz":
        n1 = {t: sum(d.get(t, 0) for r, d in w.items() if y[r] == label) for t in "abc"}
        n0 = {t: sum(d.get(t, 0) for r, d in w.items() if y[r] != label) for t in "abc"}
        lp = lambda n: {t: np.log((n[t] + 0.03) / (sum(n.values()) + 0.09)) for t in n}
        a, b = lp(n1), lp(n0)
        for r, d in w.items():
            assert got[(r, label)] == pytest.approx(1 / (1 + np.exp(-sum(v * (a[t] - b[t]) for t, v in d.items()))))


def test_external_scorer(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "row int, text string")
    got = models.external_scores(df, lambda: lambda texts, labels: np.array([[len(t) / 10] * len(labels) for t in texts]), ["p", "q"])
    assert sorted(map(tuple, got.collect())) == [(1, "p", 0.1), (1, "q", 0.1), (2, "p", 0.0), (2, "q", 0.0)]
    with pytest.raises(Exception, match="wrong shape or range"):
        models.external_scores(df, lambda: lambda texts, labels: np.full((len(texts), 2), 2.0), ["p", "q"]).collect()


def test_mixing(spark):
    pairs = [{"index": i, "en": f"e{i}", "tr": f"t{i}"} for i in range(4)]
    df = spark.createDataFrame([(pairs,)], "p array<struct<index int, en string, tr string>>")
    mix = lambda *a: df.select(variants.mix_sentences("p", F.lit("en"), *a).alias("x")).first()["x"]
    assert mix("sentence_mix", "balanced") == "e0 t1 e2 t3" and mix("sentence_mix", "light") == "e0 t1 e2 e3"
    assert mix("chunk_mix", "balanced") == "e0 e1 t2 t3" and mix("chunk_mix", "light") == "e0 e1 e2 t3"
    single = spark.createDataFrame([([{"index": 0, "en": "a b c d", "tr": "w x y"}],)], "p array<struct<index int, en string, tr string>>")
    assert single.select(variants.mix_sentences("p", F.lit("tr")).alias("x")).first()["x"] == "w c d"


def test_row_repair(spark):
    normal, long, short = [str(i) for i in range(22)], [str(i) for i in range(24)], ["1"]
    df = spark.createDataFrame([(0, normal), (1, long), (2, short)], "ord int, cells array<string>")
    got = {r["ord"]: r for r in readers.projects(df).collect()}
    assert [got[i]["repair"] for i in range(3)] == ["normal", "repaired", "malformed"]
    assert got[1]["objective"] == "15;16;17" and got[1]["human_validated"] == "22"


def test_delimited_and_zip(spark, tmp_path):
    import zipfile

    body = '﻿h1;h2\n"a;1";"two\nlines"\nb;c\n'
    (tmp_path / "x.csv").write_text(body, encoding="utf-8")
    assert [r["cells"] for r in readers.read_cells(spark, str(tmp_path / "x.csv")).orderBy("ord").collect()] == [["a;1", "two\nlines"], ["b", "c"]]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in/x.csv", body)
    assert readers.read_zip_member(spark, str(tmp_path / "x.zip"), "x.csv").count() == 2
    with pytest.raises(Exception, match="wrong archive"):
        readers.read_zip_member(spark, str(tmp_path / "x.zip"), "x.csv", sha256="0" * 64).collect()


def test_scores_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("m", "t", "r1", "a", 0.25), ("m", "t", "r1", "b", 0.5)], "member string, eval_set string, row string, label string, s double")
    sinks.write_scores(s, ["a", "b"], str(tmp_path / "s"))
    assert sorted((r["label"], r["s"]) for r in readers.read_scores(spark, str(tmp_path / "s"), "m", "t", ["a", "b"]).collect()) == [("a", 0.25), ("b", 0.5)]
    with pytest.raises(Exception, match="wrong number"):
        readers.read_scores(spark, str(tmp_path / "s"), "m", "t", ["a"]).collect()


def test_jsonl_round_trip_and_hashes(spark, tmp_path):
    df = spark.createDataFrame([(1, "ç"), (0, "x")], "ord int, text string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert [r["text"] for r in readers.read_jsonl(spark, str(tmp_path / "j"), df.schema).orderBy("ord").collect()] == ["x", "ç"]
    files = readers.file_hashes(spark, str(tmp_path / "j")).where("path like '%.json'")
    assert readers.artifact_fingerprint(files).first()["artifact_sha256"]
    assert sinks.refused("/root") and sinks.refused("file:///a/b/c", ["/a/b/c/d"]) and not sinks.refused("/a/b/c", ["/a/x/y"])


def test_record_rules(spark):
    good = ("a", "t", ["x"], ["x"], "en", "own", "cc", "train", None, None)
    bad = ("::", " ", ["x", "x"], ["q"], "fr", "cordis_h2020", "", "dev", "1", "cordis:2")
    df = spark.createDataFrame([good, bad], "id string, text string, labels array<string>, labels_direct array<string>, language string, source string, license string, split string, project_id string, pair_id string")
    got = {r["rule"] for r in audit.audit(df, audit.record_rules(F.array(F.lit("x")))).collect()}
    assert got == {"id", "text", "labels_repeated", "direct_not_closed", "language", "project_identity", "license", "split", "direct_unknown"}


def test_fixpoint(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rows = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "c")], "row int, label string")
    assert {r["label"] for r in audit.prune_to_fixpoint(rows, 2).collect()} == {"a", "b"}


def test_stream_equals_batch(spark, tmp_path):
    from arbora.streaming.scoring import score_stream

    src = spark.range(30).withColumn("v", F.col("id") * 2)
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    score = lambda d: d.select("id", (F.col("v") + 1).alias("s"))
    run = lambda: score_stream(spark, str(tmp_path / "in"), src.schema, score, str(tmp_path / "out"), str(tmp_path / "ck"), {"m": 1}, 1).awaitTermination()
    run()
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 30 and got.select("id", "s").exceptAll(score(src)).isEmpty()
    assert run_identity({"m": 1}) != run_identity({"m": 2})
    assert gaps(spark.createDataFrame([("r", 0), ("r", 2)], "run string, position int")).count() == 1


def test_prepare_job(spark):
    cells = spark.createDataFrame([(i, [str(i), "", "", f"Title {i}", *[""] * 11, f"<p>Goal {i}</p>", *[""] * 4, "1", ""]) for i in range(20)], "ord long, cells array<string>")
    assigned = spark.createDataFrame([(str(i), f"/1/{i % 2}") for i in range(20)], "pid string, code string")
    nodes = hierarchy.build_taxonomy(assigned, 3)
    got = jobs.prepare_job(cells, assigned, nodes).collect()
    assert len(got) == 20 and got[0]["text"].startswith("Title") and sorted({r["split"] for r in got}) == ["test", "train", "validation"]
    assert all(r["labels"][0] == "/1" for r in got)


def test_chrf_and_repeats(spark):
    from collections import Counter

    from arbora.operators import quality

    def plain(h, r):
        p = q = n_ = 0
        for n in range(1, 7):
            a, b = (Counter("".join(t.split())[i : i + n] for i in range(len("".join(t.split())) - n + 1)) for t in (h, r))
            if a and b:
                m = (a & b).total()
                p, q, n_ = p + m / a.total(), q + m / b.total(), n_ + 1
        return 100 * 5 * (p / n_) * (q / n_) / (4 * p / n_ + q / n_) if p + q else 0.0

    pairs = [(0, "the cat sat", "the cat sat down"), (1, "", "x"), (2, "abc", "xyz"), (3, "ab", "abab ab"), (4, "çok güzel", "cok güzel")]
    got = {r["k"]: r["chrf"] for r in quality.chrf(spark.createDataFrame(pairs, "k int, h string, r string"), ["k"], "h", "r").collect()}
    for k, h, r in pairs:
        assert got[k] == pytest.approx(plain(h, r))
    t = "a b c d a b c d e".split()
    assert list(quality.repeated_spans(t)) == [(4, 0)]
    assert list(quality.repeated_spans(["x"] * 9)) == [(4, 0), (4, 1)] and list(quality.repeated_spans(["x", "y"])) == []
    df = spark.createDataFrame([(t, "q".split()), (t, t), (["z"], ["z"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(quality.translation_repeats(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_partitions_and_exceptions(spark):
    from arbora.operators import quality

    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (2, "b")], "row int, label string")
    shapes = spark.createDataFrame([("a", "r1"), ("b", "r2")], "label string, root string")
    assert {r["row"]: r["part"] for r in quality.near_ood_partition(rows, shapes, ["r1"]).collect()} == {0: "only", 1: "none", 2: "mixed"}
    c = cells(spark, ["a", "b"], ["a", "a"])
    got = {r["part"]: r["micro_f1"] for r in quality.with_and_without(c, spark.createDataFrame([(1,)], "row int"), names(spark, "ab")).collect()}
    assert got == {"all": 0.5, "only": 0.0, "without": 1.0}
    v = lambda x: spark.createDataFrame([(0, [1.0, x])], "row int, v array<double>")
    assert quality.canary_problems(v(0.0), v(0.001)).count() == 0 and quality.canary_problems(v(0.0), v(0.1)).count() == 1


def test_terms_and_tfidf(spark):
    docs = spark.createDataFrame([(0, "The cat the cat x"), (1, "a cat sat"), (2, None)], "row int, text string")
    tf = models.terms(docs, 2)
    got = {(r["row"], r["term"]): r["tf"] for r in tf.collect()}
    assert got == {(0, "the"): 2, (0, "cat"): 2, (0, "the cat"): 2, (0, "cat the"): 1, (1, "cat"): 1, (1, "sat"): 1, (1, "cat sat"): 1}
    w = models.tfidf(tf, models.vocabulary(tf, 2, 10), 3).collect()
    assert {(r["row"], r["term"], round(r["w"], 9)) for r in w} == {(0, "cat", 1.0), (1, "cat", 1.0)}
    ids = {r["token"]: r["id"] for r in models.token_ids(tf, 4).collect()}
    assert ids == {"<PAD>": 0, "<UNK>": 1, "cat": 2, "the": 3}
    toks = spark.createDataFrame([(0, ["cat", "dog"]), (1, []), (2, ["the"] * 5)], "row int, tokens array<string>")
    enc = {r["row"]: r["ids"] for r in models.encode_tokens(toks, spark.createDataFrame(list(ids.items()), "token string, id int"), 3).collect()}
    assert enc == {0: [2, 1, 0], 1: [0, 0, 0], 2: [3, 3, 3]}


def test_linear_model_separates(spark):
    w = spark.createDataFrame([(i, t, 0.7) for i in range(30) for t in (("p", "z") if i % 2 else ("q", "z"))], "row int, term string, w double")
    truth = spark.createDataFrame([(i, "yes" if i % 2 else "no") for i in range(30)], "row int, label string")
    folds = split.group_folds(spark.range(30).select(F.col("id").cast("int").alias("row")), 3, "row")
    got = {(r["row"], r["label"]): r["s"] for r in models.score_linear(w, models.fit_linear(w, truth, folds)).collect()}
    assert all((got[(i, "yes")] > 0.5) == bool(i % 2) for i in range(30)) and len(got) == 60
