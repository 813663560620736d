"""Writers: Spark's committers publish whole directories; paths are guarded before anything is replaced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import file_hashes


def refused(path: str, inputs: Sequence[str] = ()) -> str | None:
    """Why an output path is unsafe: a root, a home, or a parent or child of an input."""
    bare = path.split("://", 1)[-1].rstrip("/")
    if bare.count("/") < 2 or bare.endswith(("/root", "/home")):
        return "too close to a root"
    for given in inputs:
        other = given.split("://", 1)[-1].rstrip("/")
        if f"{other}/".startswith(f"{bare}/") or f"{bare}/".startswith(f"{other}/"):
            return f"overlaps the input {given}"
    return None


def publish(df: DataFrame, path: str, inputs: Sequence[str] = (), form: str = "parquet") -> None:
    """Writes df beside path and swaps it in; what was there comes back if the swap fails, and goes once it is done."""
    if reason := refused(path, inputs):
        raise ValueError(reason)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    at, stage, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".stage", ".old"))
    fs = at.getFileSystem(conf)
    if fs.exists(old):  # a swap was cut off
        if fs.exists(at):
            fs.delete(old, True)
        elif not fs.rename(old, at):
            raise OSError(f"cannot restore {path}")
    df.write.mode("overwrite").format(form).save(stage.toString())
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(stage, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"cannot publish {path}")
    if had:
        fs.delete(old, True)


def write_jsonl(df: DataFrame, path: str, order: str = "ord") -> None:
    """JSON lines with CRLF ends in order, in as many files as there are range partitions."""
    placed = df.repartitionByRange(order).sortWithinPartitions(order) if order in df.columns else df
    placed.write.mode("overwrite").option("lineSep", "\r\n").json(path)


def write_split_map(records: DataFrame, path: str, seed: int | None = None, ratios: Sequence[float] = ()) -> None:
    """(project_id, split, seed, ratios, total): the settings and the number of projects go with each row.

    A project in two splits is an error.
    """
    pairs = records.select("project_id", "split").distinct()
    one = pairs.groupBy("project_id").agg(F.min("split").alias("split"), F.count("*").alias("_n"))
    checked = F.when(F.col("_n") == 1, F.col("split")).otherwise(F.raise_error(F.concat(F.lit("in two splits: "), "project_id")))
    total = one.agg(F.count("*").alias("total"))
    settings = [F.lit(seed).cast("long").alias("seed"), F.array(*(F.lit(float(r)) for r in ratios)).cast("array<double>").alias("ratios"), "total"]
    one.crossJoin(F.broadcast(total)).select("project_id", checked.alias("split"), *settings).write.mode("overwrite").parquet(path)


def write_scores(scores: DataFrame, labels: Sequence[str], path: str) -> None:
    """Rows (member, eval_set, row, label, s) as arrays in label order, one directory a member and set; a missing cell is an error."""
    order = F.array(*(F.lit(x) for x in labels))
    packed = scores.groupBy("member", "eval_set", F.col("row").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("label", F.col("s").cast("float")))).alias("m"))
    full = F.transform(order, lambda x: F.coalesce(F.try_element_at("m", x), F.raise_error(F.concat(F.lit("no score for "), x)).cast("float")))
    packed.select("id", full.alias("scores"), "member", "eval_set").write.mode("overwrite").partitionBy("member", "eval_set").parquet(path)


def write_review(sample: DataFrame, path: str) -> None:
    """A review sheet: arrays as text, empty columns for the reviewer."""
    flat = sample.select(*(F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in sample.dtypes))
    flat.withColumns({c: F.lit("pending") for c in ("review_status", "meaning_preserved", "terminology_quality", "fluency")}).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def manifest(df_path: str, spark: object, counts: DataFrame | None = None) -> DataFrame:
    """(path, sha256, bytes) of written files, to be stored beside them."""
    return file_hashes(spark, df_path) if counts is None else file_hashes(spark, df_path).crossJoin(F.broadcast(counts))  # counts: one row


def ranked_markdown(rows: DataFrame, metric: str) -> str:
    """A small ranking as a table: systems, not data, come to the driver."""
    found = rows.orderBy(F.desc(metric)).collect()
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in found)])


def payload(df: DataFrame) -> str:
    """A report's rows as one JSON text, safe inside a page."""
    return "[" + ",".join(r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect()).replace("<", "\\u003c") + "]"
