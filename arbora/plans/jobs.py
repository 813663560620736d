"""Jobs: what the commands do, as functions from tables to tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, decide, hierarchy, metrics, stats
from ..operators.audit import PAIR_PREFIX
from ..operators.blocks import Blocks
from ..sources import readers, sinks


def taxonomy_job(assignments: DataFrame, min_support: int, out: str) -> DataFrame:
    """Builds, checks and writes a tree, unless the same one is already there."""
    nodes = hierarchy.build_taxonomy(assignments, min_support)
    problems = hierarchy.validate_tree(nodes).limit(5).collect()
    if problems:
        raise ValueError(f"bad tree: {problems}")
    if reason := sinks.refused(out):
        raise ValueError(reason)
    nodes.write.mode("overwrite").parquet(out)
    return nodes


def prepare_job(cells: DataFrame, assigned: DataFrame, nodes: DataFrame, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Records of cleaned texts with direct and closed labels and a stratified split; projects left without a label go."""
    from ..functions.text import clean_record_text, content_fingerprint
    from ..operators.split import stratified_split

    kept = assigned.join(F.broadcast(nodes.where("is_direct_supported").select(F.col("id").alias("code"))), "code")
    up = hierarchy.close_labels(kept.select(F.col("pid").alias("row"), F.col("code").alias("label")), hierarchy.closure(nodes)).groupBy(F.col("row").alias("pid")).agg(F.array_sort(F.collect_set("node")).alias("labels"))
    direct = kept.groupBy("pid").agg(F.array_sort(F.collect_set("code")).alias("labels_direct"))
    rows = readers.projects(cells).where("repair <> 'malformed'").withColumn("text", clean_record_text(F.concat_ws(" ", "title", "objective"))).where("text <> ''")
    met = rows.join(direct, F.col("project_id") == F.col("pid")).drop("pid").join(up, F.col("project_id") == F.col("pid")).drop("pid")
    named = met.select(F.concat_ws(":", F.lit(PAIR_PREFIX), "project_id", F.lit("en")).alias("id"), F.concat_ws(":", F.lit(PAIR_PREFIX), "project_id").alias("pair_id"), "project_id", "text", "labels_direct", "labels", "ord", content_fingerprint("text").alias("content_fingerprint"))
    placed = stratified_split(named, ratios, seed)
    return placed.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), F.col("split") + 1))


def evaluate_members(cells: DataFrame, labels: DataFrame, rows: DataFrame, closed: DataFrame) -> DataFrame:
    """A row a member: flat, document and hierarchical micro metrics at the cells' selection."""
    flat = metrics.flat_metrics(cells, labels, ["member"]).join(metrics.document_metrics(cells, rows, ["member"]), "member")
    hier = hierarchical_cells(cells, closed)
    up = metrics.counts(hier, ["member"]).select("member", metrics.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("hmicro_f1"))
    return flat.join(up, "member")


def hierarchical_cells(cells: DataFrame, closed: DataFrame, by: str = "member") -> DataFrame:
    """Cells in node space: gold and predicted labels closed under ancestors."""
    met = cells.where("y = 1 or p = 1").join(F.broadcast(closed.select("label", "ancestor")), "label")
    return met.groupBy(by, "row", F.col("ancestor").alias("label")).agg(F.max("y").alias("y"), F.max("p").alias("p"))


@dataclass(frozen=True)
class Tuned:
    """What the tuning protocol fixes before a test set is looked at: a handful of numbers."""

    thresholds: dict[str, float]
    weights: dict[str, float]
    k: int
    k_closed: int
    soft: float
    weighted: float


def tune_protocol(first: Blocks, second: Blocks, up: tuple[tuple[str, ...], np.ndarray]) -> Tuned:
    """Member thresholds and weights from one half of the validation rows; votes, in label and node space, and soft thresholds from the other.

    up names the nodes above each label. Each half is read once, and only sums leave a task.
    """
    members = first.members
    found = decide.best_threshold(blocks.threshold_steps(first, decide.GRID), ["member"]).collect()  # a row a member
    thresholds, weights = {r["member"]: r["threshold"] for r in found}, {r["member"]: r["micro_f1"] for r in found}
    at, w = [thresholds[m] for m in members], [weights[m] for m in members]
    votes = blocks.vote_counts(second, at)
    in_nodes = blocks.vote_counts(second, at, up[1])
    k, k_closed = (decide.best_k(v.where("votes > 0"), v.agg(F.sum("y").alias("gold")), len(members)).first()["k"] for v in (votes, in_nodes))
    soft = decide.best_threshold(blocks.soft_steps(second, decide.GRID, w), ["member"]).collect()
    best = {r["member"]: r["threshold"] for r in soft}
    return Tuned(thresholds, weights, k, k_closed, best["soft"], best["weighted"])


def benchmark_job(test: Blocks, nodes: DataFrame, up: tuple[tuple[str, ...], np.ndarray], labels: DataFrame, tuned: Tuned) -> DataFrame:
    """(system, measure, value) on test rows: members, majority, k votes, votes in node space, soft votes, leave-one-out.

    Votes in node space add ancestors, so they have hierarchical measures only; leave-one-out systems are named `without x`.
    """
    parents = [(r["id"], r["parent"]) for r in nodes.where("parent is not null").select("id", "parent").collect()]  # one tree
    flat, in_nodes, broken = blocks.benchmark_counts(test, tuned, up, parents, decide.majority(len(test.members)))
    measures = metrics.flat_metrics(flat.where("not system like 'without %'"), labels, ["system"])
    micro = lambda found, name: metrics.counts(found, ["system"]).select("system", F.lit(name).alias("measure"), metrics.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("value"))
    long = measures.unpivot("system", [c for c in measures.columns if c != "system"], "measure", "value")
    rate = broken.select(F.lit("hard_closed").alias("system"), F.lit("hierarchy_violation_rate").alias("measure"), (F.col("bad") / F.col("n")).alias("value"))
    return long.unionByName(micro(in_nodes, "hmicro_f1")).unionByName(rate).unionByName(micro(flat.where("system like 'without %'"), "micro_f1"))


def significance_job(cells: DataFrame, pairs: DataFrame, replicates: int = 1000) -> DataFrame:
    return stats.bootstrap_family(cells, pairs, replicates)


def classify_job(texts: DataFrame, score: object, closed: DataFrame, threshold: float, ood_at: float) -> DataFrame:
    """Prediction rows of texts (row, text): any scorer to (row, label, s), then thresholds, paths and OOD."""
    from ..functions.text import normalize_text

    clean = texts.withColumn("text", normalize_text("text"))
    clean = clean.withColumn("text", F.when(F.col("text") != "", F.col("text")).otherwise(F.raise_error(F.lit("a text is empty"))))
    scores = score(clean)
    return decide.finish(decide.apply_thresholds(scores, threshold), clean, scores, closed, ood_at)


def score_table_job(spark: SparkSession, path: str, member: str, eval_set: str, labels: list[str], truth: DataFrame, threshold: float) -> DataFrame:
    """Metrics of a stored member on a set."""
    s = readers.read_scores(spark, path, member, eval_set, labels)
    names = spark.createDataFrame([(x,) for x in labels], "label string")
    found = metrics.joined_cells(truth, s.where(F.col("s") >= threshold).select("row", "label"))
    return metrics.flat_metrics(found, names)
