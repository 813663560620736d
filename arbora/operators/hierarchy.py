"""Trees as tables: nodes (id, parent, ...) and one closure table (label, ancestor, distance)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_prefixes

#: Levels after which a walk up must be a cycle.
MAX_DEPTH = 64


def build_taxonomy(assignments: DataFrame, min_support: int | object, names: DataFrame | None = None) -> DataFrame:
    """Nodes of a tree of codes (pid, code): codes with enough distinct projects, and all their ancestors.

    Columns id (the code), name (last part, or from names (code, name)), parent, depth, is_root, is_leaf,
    is_direct_supported, support (null for nodes that are there only as ancestors).
    """
    supported = assignments.groupBy("code").agg(F.count_distinct("pid").alias("support")).where(F.col("support") >= min_support)
    nodes = supported.select(F.explode(code_prefixes("code")).alias("id")).distinct()
    parts = F.filter(F.split("id", "/"), lambda x: x != "")
    shaped = nodes.select(
        "id", F.element_at(parts, -1).alias("name"), F.size(parts).alias("depth"),
        F.when(F.size(parts) > 1, F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))).alias("parent"),
    )
    inner = shaped.where("parent is not null").select(F.col("parent").alias("id"), F.lit(False).alias("leaf")).distinct()
    out = shaped.join(supported.withColumnRenamed("code", "id"), "id", "left").join(inner, "id", "left")
    if names is not None:
        named = names.select(F.col("code").alias("id"), F.col("name").alias("given"))
        out = out.join(named, "id", "left").withColumn("name", F.coalesce("given", "name"))
    return out.select("id", "name", "parent", "depth", F.col("parent").isNull().alias("is_root"), F.coalesce("leaf", F.lit(True)).alias("is_leaf"), F.col("support").isNotNull().alias("is_direct_supported"), "support")


def alias_map(taxonomy: DataFrame, code: str = "id", path: str = "id", name: str = "name") -> DataFrame:
    """(alias, id): code, path and name of each node; a name that two nodes share names neither."""
    pairs = taxonomy.select(F.col("id"), F.explode(F.array_distinct(F.array(code, path, name))).alias("alias"))
    single = pairs.groupBy("alias").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1")
    return single.select("alias", "id")


def closure(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(label, ancestor, distance), each node its own ancestor at 0; a walk stops at a missing parent or at max_depth."""
    spark = nodes.sparkSession
    nodes.select("id", "parent").createOrReplaceTempView("_arbora_nodes")
    return spark.sql(
        f"""WITH RECURSIVE walk(label, ancestor, distance) MAX RECURSION LEVEL {max_depth + 2} AS (
              SELECT id, id, 0 FROM _arbora_nodes
              UNION ALL
              SELECT w.label, n.parent, w.distance + 1 FROM walk w JOIN _arbora_nodes n ON n.id = w.ancestor
              WHERE n.parent IS NOT NULL AND w.distance < {max_depth})
            SELECT label, ancestor, distance FROM walk"""
    )


def close_labels(rows: DataFrame, closed: DataFrame, row: str = "row", strict: bool = False) -> DataFrame:
    """(row, node): labels of rows (row, label) with all ancestors.

    Lenient: a label outside the tree stays by itself. Strict: it is an error.
    """
    met = rows.join(closed.select("label", "ancestor"), "label", "left")
    missing = F.raise_error(F.concat(F.lit("not in the tree: "), F.col("label"))) if strict else F.col("label")
    return met.select(row, F.coalesce("ancestor", missing).alias("node")).distinct()


def paths(closed: DataFrame) -> DataFrame:
    """(label, path): root-to-label node lists."""
    return closed.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))), lambda x: x["ancestor"]).alias("path"))


def row_paths(rows: DataFrame, closed: DataFrame, row: str = "row") -> DataFrame:
    """(row, hierarchy_paths): the sorted unique paths of a row's labels."""
    return rows.join(paths(closed), "label").groupBy(row).agg(F.array_sort(F.collect_set("path")).alias("hierarchy_paths"))


def shapes(closed: DataFrame) -> DataFrame:
    """(label, depth, root) of each node; a root has depth 1."""
    return closed.groupBy("label").agg((F.max("distance") + 1).alias("depth"), F.max_by("ancestor", "distance").alias("root"))


def validate_tree(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(problem, node): missing parents, cycles, blank ids or names and repeated ids; sorted, without repeats."""
    kept = nodes.where("id is not null")
    missing = kept.where("parent is not null").join(kept.select(F.col("id").alias("parent")), "parent", "left_anti").select(F.lit("missing_parent").alias("problem"), F.col("id").alias("node"))
    blank = nodes.where("id is null or trim(id) = ''").select(F.lit("blank_id").alias("problem"), F.coalesce("id", F.lit("")).alias("node"))
    unnamed = kept.where("name is null or trim(name) = ''").select(F.lit("blank_name").alias("problem"), F.col("id").alias("node")) if "name" in nodes.columns else missing.limit(0)
    twice = kept.groupBy("id").count().where("count > 1").select(F.lit("repeated_id").alias("problem"), F.col("id").alias("node"))
    once = kept.dropDuplicates(["id"])
    walked = closure(once, max_depth).where(F.col("distance") >= max_depth).select(F.lit("cycle").alias("problem"), F.col("label").alias("node"))
    out = missing
    for part in (blank, unnamed, twice, walked):
        out = out.unionByName(part)
    return out.distinct().orderBy("problem", "node")


def violations(rows: DataFrame, nodes: DataFrame, row: str = "row") -> DataFrame:
    """(row, child, missing_parent): labels of rows (row, label) whose parent the row lacks."""
    child = rows.join(nodes.where("parent is not null").select(F.col("id").alias("label"), "parent"), "label")
    return child.join(rows.select(row, F.col("label").alias("parent")), [row, "parent"], "left_anti").select(row, F.col("label").alias("child"), F.col("parent").alias("missing_parent"))


def violation_rate(rows: DataFrame, nodes: DataFrame, every: DataFrame, row: str = "row") -> DataFrame:
    """One row: the share of the rows in every that break the hierarchy somewhere."""
    bad = violations(rows, nodes, row).select(row, F.lit(1).alias("bad")).distinct()
    return every.select(row).distinct().join(bad, row, "left").agg(F.avg(F.coalesce("bad", F.lit(0))).alias("violation_rate"))


def nearest_supported(codes: DataFrame, supported: DataFrame) -> DataFrame:
    """(code, nearest): the longest proper prefix of each code that is supported, else null."""
    ends = codes.select("code").distinct().select("code", F.posexplode(code_prefixes("code")).alias("k", "prefix")).where("prefix <> code")
    met = ends.join(supported.select(F.col("code").alias("prefix")), "prefix")
    best = met.groupBy("code").agg(F.max_by("prefix", "k").alias("nearest"))
    return codes.select("code").distinct().join(best, "code", "left")


def implied_nodes(assignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pid, node): tree nodes on the paths of a project's codes."""
    ends = assignments.select("pid", F.explode(code_prefixes("code")).alias("node")).distinct()
    return ends.join(nodes.select(F.col("id").alias("node")), "node").select("pid", "node")


def coverage_counts(projects: DataFrame, assignments: DataFrame, nodes: DataFrame, stored: DataFrame, direct: DataFrame) -> DataFrame:
    """Per split and for all: how far the stored labels fall short of the assigned codes.

    projects (pid, split), assignments (pid, code), stored and direct (pid, label). The ten counts are
    projects, projects losing codes and codes lost, projects whose roll-up would add a label, closures and
    nodes missing, projects and roots missing, closures and paths missing of the unpruned tree.

    Codes and nodes (of one tree) are numbered by the driver. Slim rows of all four tables meet in one spilling sort by project and
    are counted as a stream; only sums leave a task.
    """
    spark = projects.sparkSession
    codes = assignments.where("code is not null").select("code").distinct()
    supported = nodes.where("is_direct_supported").select(F.col("id").alias("code"))
    met = codes.select("code", code_prefixes("code").alias("up")).join(nearest_supported(codes, supported), "code").collect()  # codes of one tree
    names = sorted({x for r in met for x in (r["code"], *r["up"])})
    at = {x: i for i, x in enumerate(names)}
    depth = max((len(r["up"]) for r in met), default=1)
    up, nearest, direct_ok = np.full((len(names), depth), -1), np.full(len(names), -1), np.zeros(len(names), bool)
    for r in met:
        up[at[r["code"]], : len(r["up"])] = [at[x] for x in r["up"]]
        nearest[at[r["code"]]] = at.get(r["nearest"], -1)
    for r in supported.distinct().collect():
        if r["code"] in at:
            direct_ok[at[r["code"]]] = True
    in_tree, is_root = np.zeros(len(names), bool), np.zeros(len(names), bool)
    for r in nodes.select("id", "is_root").collect():
        if r["id"] in at:
            in_tree[at[r["id"]]], is_root[at[r["id"]]] = True, bool(r["is_root"])
    numbers = F.broadcast(spark.createDataFrame([(x, i) for x, i in zip(names, range(len(names)), strict=True)], "_label string, i int"))
    slim = lambda d, label, kind: d.where("pid is not null").join(numbers, F.col(label) == F.col("_label")).select("pid", F.lit(kind).alias("kind"), "i", F.lit(None).cast("string").alias("split"))
    rows = slim(assignments, "code", 0).unionByName(slim(stored, "label", 1)).unionByName(slim(direct, "label", 2)).unionByName(projects.select("pid", F.lit(3).alias("kind"), F.lit(0).alias("i"), F.col("split").cast("string").alias("split")))
    counts = ("projects", "projects_losing_codes", "codes_lost", "projects_rollup_would_add_label", "closures_missing_nodes", "nodes_missing", "projects_missing_root", "roots_missing", "closures_missing_unpruned_paths", "unpruned_paths_missing")

    def count(pid: pa.Array, kind: np.ndarray, i: np.ndarray, split: pa.Array) -> pa.RecordBatch:
        new = pc.fill_null(pc.not_equal(pid.slice(1), pid.slice(0, len(pid) - 1)), True).to_numpy(zero_copy_only=False)
        group = np.concatenate(([0], np.cumsum(new))).astype(np.int64)
        size = max(1, len(names))
        key, n = group * size + i, int(group[-1]) + 1
        own = np.unique(key[kind == 0])
        g, code = own // size, own % size
        lost = ~direct_ok[code]
        rolled = np.flatnonzero(lost & (nearest[code] >= 0))
        added = np.setdiff1d(g[rolled] * size + nearest[code[rolled]], key[kind == 2])
        path, k = np.nonzero(up[code] >= 0)
        gap = np.setdiff1d(g[path] * size + up[code[path], k], key[kind == 1])
        tree = in_tree[gap % size]
        per = [np.bincount(x, minlength=n) for x in (g[lost], added // size, gap[tree] // size, gap[tree & is_root[gap % size]] // size, gap // size)]
        at = np.flatnonzero(kind == 3)
        named = split.take(pa.array(at)).dictionary_encode(null_encoding="encode")
        which, one = named.indices.to_numpy(zero_copy_only=False), [x[group[at]] for x in per]
        sums = [np.ones(len(at)), one[0] > 0, one[0], one[1] > 0, one[2] > 0, one[2], one[3] > 0, one[3], one[4] > 0, one[4]]
        made = [pa.array(np.bincount(which, x, len(named.dictionary)).astype(np.int64)) for x in sums]
        return pa.RecordBatch.from_arrays([named.dictionary, *made], names=["split", *counts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined(upto: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(upto).combine_chunks()
            column = [table.column(c).chunk(0) for c in range(4)]
            return count(column[0], column[1].to_numpy(), column[2].to_numpy(), column[3])

        for b in batches:
            if not b.num_rows:
                continue
            differs = pc.fill_null(pc.not_equal(b.column(0), b.column(0)[b.num_rows - 1]), True).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0  # where the last project of the batch begins
            if cut:
                yield joined([*held, b.slice(0, cut)])
                held = []
            elif held and held[-1].column(0)[held[-1].num_rows - 1].as_py() != b.column(0)[0].as_py():
                yield joined(held)
                held = []
            if cut < b.num_rows:
                held.append(b.slice(cut))
        if held:
            yield joined(held)

    placed = rows.repartition("pid").sortWithinPartitions("pid").mapInArrow(run, "split string, " + ", ".join(f"{c} long" for c in counts))
    return placed.rollup("split").agg(*(F.sum(c).alias(c) for c in counts)).withColumn("split", F.coalesce("split", F.lit("all")))


def unchanged(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def row_order(df: DataFrame, *keys: str) -> DataFrame:
    """Adds ord, 0 up, by keys: a stated order where a file's order was meant. Range-partitioned, no single task."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    inside = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    ahead = inside.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(ahead.select("_part", "_ahead"), "_part").withColumn("ord", F.col("_ahead") + F.col("_k") - 1).drop("_part", "_k", "_ahead")
