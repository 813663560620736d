"""Small readers, writers, joins and settings on hand-computed cases."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions import arrays, text
from arbora.operators import audit, decide, hierarchy, joins, quality, split, stats, variants
from arbora.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_array_functions(spark):
    lit = lambda xs: F.array(*(F.lit(x) for x in xs))
    assert one(spark, arrays.clipped(F.lit(1.5))) == 1.0 and one(spark, arrays.clipped(F.lit(-2.0))) == 0.0
    assert one(spark, arrays.merged_tokens(F.array(lit("ab"), lit("bc")))) == ["a", "b", "c"]
    assert one(spark, arrays.l2_normalized(lit([3.0, 4.0]))) == [0.6, 0.8] and one(spark, arrays.l2_normalized(lit([0.0, 0.0]))) == [0.0, 0.0]
    assert one(spark, arrays.json_path(F.lit('{"a":{"b":7}}'), "$.a.b")) == "7"
    with pytest.raises(Exception, match="no value at"):
        one(spark, arrays.json_path(F.lit("{}"), "$.a.b"))
    assert [one(spark, arrays.rounded(F.lit(x).cast("decimal(10,5)"))) for x in ("0.00005", "0.00015")] == [0, pytest.approx(__import__("decimal").Decimal("0.0002"))]
    assert one(spark, arrays.label_set(lit("bab"))) == ["a", "b"] and one(spark, arrays.sigmoid(F.lit(0.0))) == 0.5
    assert arrays.merged({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "b": {"z": 4}, "c": 5}) == {"a": {"x": 1, "y": 3}, "b": {"z": 4}, "c": 5}


def test_text_functions(spark):
    assert one(spark, text.word_and_symbol_tokens(F.lit("Ab, c!"))) == ["Ab", ",", "c", "!"]
    assert one(spark, text.space_tokens(F.lit("  a  b "))) == ["a", "b"] and one(spark, text.without_space(F.lit(" a b "))) == "ab"
    assert one(spark, text.label_questions("Is it {name}?", F.lit("law"))) == "Is it law?"
    with pytest.raises(ValueError):
        text.label_questions("no field", F.lit("law"))


def test_assignments_and_taxonomy(spark, tmp_path):
    cells = spark.createDataFrame([(["/1", "", "Law", "", "p1"],), (["/2", "", "Art", "", "p1", "more"],), (["/2", "", "Art", "", "p1"],), (["", "", "No", "", "p2"],), (["/1", "", "Short"],)], "cells array<string>")
    found = readers.assignments(cells)
    assert found.count() == 3 and readers.codes_by_project(found).first().asDict() == {"pid": "p1", "codes": ["/1", "/2"], "titles": ["Art", "Law"]}
    tree = lambda code: {"labels": [{"id": "a", "name": "A", "parent": None, "euroscivoc_code": "/1", "is_direct_supported": True, "depth": 0}, {"id": "b", "name": "B", "parent": "a", "euroscivoc_code": code, "is_direct_supported": True, "depth": 1}]}
    (tmp_path / "good.json").write_text(json.dumps(tree("/1/7"), indent=1))
    (tmp_path / "bad.json").write_text(json.dumps(tree("/2/7")))
    assert readers.read_taxonomy(spark, str(tmp_path / "good.json")).count() == 2
    with pytest.raises(Exception, match="outside its parent"):
        readers.read_taxonomy(spark, str(tmp_path / "bad.json")).collect()


def test_sets_and_texts(spark, tmp_path):
    assert readers.parse_sets(["a=x", "b=y=z"]) == {"a": "x", "b": "y=z"}
    for bad in (["a=x", "a=y"], ["a"], ["=x"], ["a="]):
        with pytest.raises(ValueError):
            readers.parse_sets(bad)
    scores = lambda rows: spark.createDataFrame(rows, "member string, row int, label string, s double")
    both = readers.union_sets({"u": scores([("m", 0, "a", 0.1), ("m", 0, "b", 0.2), ("n", 0, "a", 0.1)]), "v": scores([("m", 1, "a", 0.1), ("m", 1, "b", 0.1), ("m", 2, "a", 0.3)])})
    assert both.count() == 6
    assert {tuple(r) for r in readers.label_disagreements(both).collect()} == {("u", "n", "b", 0, 1), ("v", "m", "b", 1, 2)}
    (tmp_path / "t.jsonl").write_text('{"text": "one"}\n\n{"text": "two"}\n')
    assert {r["text"] for r in readers.read_texts(spark, str(tmp_path / "t.jsonl")).collect()} == {"one", "two"}
    (tmp_path / "e.jsonl").write_text('{"text": "  "}\n')
    with pytest.raises(Exception, match="no text in"):
        readers.read_texts(spark, str(tmp_path / "e.jsonl")).collect()


def test_publish_swaps_and_restores(spark, tmp_path):
    path = str(tmp_path / "deep" / "er" / "out")
    rows = lambda n: spark.range(n)
    sinks.publish(rows(3), path)
    sinks.publish(rows(5), path)
    assert spark.read.parquet(path).count() == 5 and sorted(x for x in os.listdir(os.path.dirname(path)) if not x.startswith(".")) == ["out"]
    with pytest.raises(Exception):
        sinks.publish(rows(2).select(F.raise_error(F.lit("broken")).cast("int").alias("x")), path)
    assert spark.read.parquet(path).count() == 5
    os.rename(path, path + ".old")  # as a cut-off swap leaves it
    sinks.publish(rows(7), path)
    assert spark.read.parquet(path).count() == 7 and not os.path.exists(path + ".old")
    with pytest.raises(ValueError, match="overlaps"):
        sinks.publish(rows(1), path, inputs=[path + "/x"])


def test_small_writers(spark, tmp_path):
    records = spark.createDataFrame([("p", "train"), ("p", "train"), ("q", "test")], "project_id string, split string")
    sinks.write_split_map(records, str(tmp_path / "map"), 42, (0.8, 0.2))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "map")).collect())) == [("p", "train", 42, [0.8, 0.2], 2), ("q", "test", 42, [0.8, 0.2], 2)]
    with pytest.raises(Exception, match="in two splits"):
        sinks.write_split_map(records.union(spark.createDataFrame([("q", "train")], records.schema)), str(tmp_path / "twice"))
    sinks.write_review(spark.createDataFrame([("r", ["a", "b"])], "id string, labels array<string>"), str(tmp_path / "review"))
    sheet = spark.read.option("header", True).csv(str(tmp_path / "review")).first()
    assert (sheet["labels"], sheet["fluency"]) == ("a;b", "pending")
    ranks = spark.createDataFrame([("a", 0.25), ("b", 0.5)], "system string, f double")
    assert sinks.ranked_markdown(ranks, "f").splitlines()[2:] == ["| b | 0.5000 |", "| a | 0.2500 |"]
    assert json.loads(sinks.payload(spark.createDataFrame([("<b>",)], "t string"))) == [{"t": "<b>"}] and "<" not in sinks.payload(spark.createDataFrame([("<b>",)], "t string"))
    files = sinks.manifest(str(tmp_path / "review"), spark)
    stored = files.withColumn("bytes", F.col("bytes") + F.when(F.col("path").endswith(".csv"), 1).otherwise(0))
    assert {r["rule"] for r in audit.manifest_problems(stored, files).collect()} == {"bytes"} and audit.manifest_problems(files, files).isEmpty()


def test_joins_and_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert joins.aligned(a, a.orderBy(F.desc("k")), "k").count() == 2
    with pytest.raises(ValueError, match="not comparable"):
        joins.aligned(a, a.where("k = 1"), "k")
    marked = joins.flagged(a, spark.createDataFrame([(2,), (2,)], "k int"), "k")
    assert sorted((r["k"], r["is_exception"]) for r in marked.collect()) == [(1, False), (2, True)]
    assert hierarchy.unchanged(a, a) and not hierarchy.unchanged(a, a.union(a)) and audit.regenerated(a, a).isEmpty()
    assert [r["side"] for r in audit.regenerated(a, a.where("k = 1")).collect()] == ["left"]


def test_votes_members_and_samples(spark):
    voted = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "a", 3)], "row int, label string, votes long")
    assert sorted((r["row"], r["label"]) for r in decide.hard_majorities(voted, 3, 0.5).collect()) == [(0, "a"), (1, "a")]
    assert sorted((r["row"], r["label"]) for r in decide.hard_majorities(voted, 3, 0.9).collect()) == [(1, "a")]
    scores = spark.createDataFrame([(0, "m", "t"), (0, "n", "u"), (1, "m", "t"), (2, "m", "t"), (2, "n", "t")], "row int, member string, text string")
    assert {tuple(r) for r in decide.member_set_problems(scores, ["n", "m"]).collect()} == {(0, "text"), (1, "members")}
    members = spark.createDataFrame([("z", "zero"), ("t", "trained"), ("s", "trained")], "member string, kind string")
    assert {tuple(r) for r in stats.member_pairs(members, "zero", "trained").collect()} == {("z", "t"), ("z", "s")}
    rows = spark.createDataFrame([("i", "", "p", 2), ("j", None, "", 1), ("k", "q", "p", 3)], "id string, pair_id string, project_id string, ord int")
    assert {r["id"]: r["g"] for r in rows.select("id", split.fold_group().alias("g")).collect()} == {"i": "p", "j": "j", "k": "q"}
    assert [r["id"] for r in split.first_n(rows, 2).collect()] == ["j", "i"] and split.exact_ratios("7/2/1") == [0.7, 0.2, 0.1]
    drawn = lambda n: {r["id"] for r in split.seeded_sample(rows.repartition(n), 2).collect()}
    assert len(drawn(1)) == 2 and drawn(1) == drawn(3)
    effect = spark.createDataFrame([("a", 0.5, 0.4), ("b", 0.4, 0.45)], "member string, hmicro_f1_stored double, hmicro_f1_complete double")
    summary = quality.closure_summary(effect).first()
    assert summary["max_abs_hmicro_f1_change"] == pytest.approx(0.1) and not summary["ranking_unchanged"]


def test_bootstraps_do_not_depend_on_the_steps(spark, monkeypatch):
    counts = spark.createDataFrame([(f"p{k}", k % 3, k % 2, k % 4, 1) for k in range(30)], "pair_id string, tp_a int, err_a int, tp_b int, err_b int")
    whole = np.random.default_rng(7).multinomial(9, np.full(9, 1 / 9), size=50)
    monkeypatch.setattr(stats, "HELD", 20)
    gen = stats.passed_over(np.random.default_rng(7), 9, np.full(9, 1 / 9), 13)
    assert np.array_equal(np.concatenate(list(stats.drawn(gen, 9, np.full(9, 1 / 9), 37))), whole[13:])
    monkeypatch.undo()
    rng = np.random.default_rng(3)
    s = [(float(x), False) for x in rng.integers(0, 6, 40)] + [(float(x), True) for x in rng.integers(3, 9, 25)]
    got = stats.auroc_interval(spark.createDataFrame(s, "s double, is_ood boolean"), 300).first()
    sides = [np.array([x for x, o in s if o == side]) for side in (False, True)]
    values = [np.unique(x, return_counts=True) for x in sides]
    drawn = [np.random.default_rng(seed).multinomial(c.sum(), c / c.sum(), size=300) for seed, (_, c) in zip((42, 43), values, strict=True)]
    wins = (values[0][0][:, None] < values[1][0]) + 0.5 * (values[0][0][:, None] == values[1][0])
    aucs = [i @ wins @ o / (40 * 25) for i, o in zip(*drawn, strict=True)]
    assert (got["ci_low"], got["ci_high"]) == (pytest.approx(np.percentile(aucs, 2.5)), pytest.approx(np.percentile(aucs, 97.5)))
    assert stats.paired_bootstrap(counts, 300).first()["p_value"] > 0


def test_mixed_records_agree_in_direct_labels(spark):
    schema = "id string, pair_id string, text string, split string, labels array<string>, labels_direct array<string>, sentence_alignment string"
    rec = lambda side, direct: spark.createDataFrame([(f"c:1:{side}", "c:1", "One. Two.", "train", ["a", "b"], direct, None)], schema)
    assert variants.code_switched(rec("en", ["b"]), rec("tr", ["b"]).drop("sentence_alignment")).count() == 1
    with pytest.raises(Exception, match="unlike pair"):
        variants.code_switched(rec("en", ["b"]), rec("tr", ["a"]).drop("sentence_alignment")).collect()
