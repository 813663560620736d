"""Shared pieces: the shared work folder, written tables, Arrow passes and labelled samples."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch handed to Python at most (a longer text has a batch of its own): bounds a worker's memory.
ARROW_ROWS, ARROW_BYTES = "1000", "8m"

_folders: dict[str, str] = {}


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one all executors share (spark.checkpoint.dir).

    Without that setting, a session on one machine uses its warehouse; on a cluster it is an error, since no
    local folder would do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/arbora-checkpoints"
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{root.rstrip('/')}/arbora-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has gone; the folder is left to the cluster's own cleaning
        return


def delete_path(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arbora_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table made by written() once nothing reads it any more."""
    if path := getattr(df, "_arbora_path", None):
        delete_path(df.sparkSession, path)


def bounded_batches(spark: SparkSession) -> None:
    """Texts may be long: hands Python fewer rows and bytes at once, unless the session chose numbers itself.

    The settings stay with the session, since a plan reads them when it runs.
    """
    for name, size in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key) in ("10000", "64MB", "67108864b"):  # as Spark sets them
            spark.conf.set(key, size)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def arrow_pass(
    df: DataFrame, columns: list[str], schema: T.StructType, work: Callable[[pa.RecordBatch], dict[str, object] | None]
) -> DataFrame:
    """One Arrow pass over the given columns of df; work turns a batch into the columns of schema."""
    bounded_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (made := work(batch)) is not None:
                yield pa.RecordBatch.from_arrays([as_array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def as_array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def with_columns_pass(
    df: DataFrame, text_col: str, extra: T.StructType, work: Callable[[list[bytes]], dict[str, object]]
) -> DataFrame:
    """df with more columns computed from its text in one Arrow pass; every row and column is kept."""
    bounded_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(extra)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(text_bytes(batch.column(at)))
            arrays = [*batch.columns, *(as_array(made[f.name], f.type) for f in arrow)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *arrow.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *extra.fields]))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_number(name: str) -> object:
    """A column as long; what is no whole number is an error, null stays null."""
    found = F.col(name).try_cast("long")
    wrong = F.col(name).isNotNull() & (found.isNull() | (found.cast("string") != F.col(name).cast("string")))
    return F.when(wrong, F.raise_error(F.lit(f"{name} is no whole number"))).otherwise(found).cast("long")


def starts_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def crc_fold(id_col: str) -> object:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, y, text) of at most per_class documents of each label: a bounded sample in hash order.

    Rows whose id has crc32 modulo 4 equal to 2, or no id or label, are never used. An id labelled
    twice counts with its largest label.
    """
    ids = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .where(F.crc32(F.col("_id").cast("string").cast("binary")) % 4 != 2)
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
    )
    chosen = None
    for y in (0, 1):
        part = ids.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    bounded = F.broadcast(chosen)  # at most 2 * per_class ids
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(bounded, "_id")


def label_counts(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> tuple[int, int]:
    """Rows with label 0 and 1 among those that may be learnt from."""
    rows = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (crc_fold(id_col) != 2))
        .groupBy(F.col(label_col).cast("int").alias("y"))
        .count()
        .collect()  # two rows
    )
    found = {r["y"]: r["count"] for r in rows}
    return found.get(0, 0), found.get(1, 0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

