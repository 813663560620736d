"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected target / source size times in the mix. Documents stand in order
of size within their source, the expected copies are summed along that order, one random offset a
source is added, and a copy is emitted for each integer boundary that a document's stretch crosses.
Sums are integers (24 binary places), so they are exact in any grouping and reruns agree.

The prefix sums are distributed: rows are range-partitioned in order, each (partition, source) gets
a total, and only those totals are summed in order.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, free_name, text_bytes, written

#: Most copies of a document, and multiple of a source's size, in the mix.
MOST = 3
PLACES = 24
WEIGHTS = (1, 2, 3)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, th, size): words of each text; null text has none."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("source", T.StringType()), T.StructField("th", T.LongType()), T.StructField("size", T.LongType())])
    named = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.col(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "source": batch.column(1), "th": batch.column(2), "size": pa.array([len(x.split()) for x in text_bytes(batch.column(3))], pa.int64())}

    return arrow_pass(named, ["id", "source", "th", "text"], schema, work)


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): one row a source.

    Sources by code point, null last, weigh `weights` repeating and share the sum of all sizes; a
    target stops at `most` times its source, and the excess goes to the others by weight. With sources in
    order of limit / weight, all from the first that its share does not fill get weight * level.
    """
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), "source")  # one row a source
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = own.withColumn("w", weight.cast("long")).withColumn("limit", F.col("source_size") * F.lit(most))
    filling = Window.orderBy(F.col("limit").cast("double") / F.col("w"), F.col("source").isNull(), "source")
    steps = (
        rows.withColumn("full", F.coalesce(F.sum("limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("open"))
    )
    fits = F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return steps.select("source", "source_size", F.least(F.col("limit").cast("double"), level * F.col("w")).alias("target"))


def offset(source: object, seed: str = "mix") -> object:
    """The random offset of a source in units of 2**-24, from the seed and its name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("")))), 1, 6), 16, 10).cast("long")


def copies(sized: DataFrame, target: DataFrame, seed: str = "mix") -> DataFrame:
    """(id, source, th, size, n, source_size, target, before, rate): rows of equal order, prefix-summed.

    n rows are alike (same source, size, id and text); the k-th of them emits
    floor(before + k rate) - floor(before + (k - 1) rate) copies, in units of 2**-24.
    """
    alike = sized.groupBy("source", "size", "id", "th").agg(F.count("*").alias("n"))
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.lit(float(1 << PLACES)))).otherwise(0).cast("long")
    rated = alike.join(target.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("id").asc_nulls_first(), F.col("th")]
    placed = written(rated.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "mix-order")
    sums = placed.groupBy("part", "source").agg(F.sum(F.col("n") * F.col("rate")).alias("sum"))
    along = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(F.col("part").alias("p"), F.col("source").alias("s"), F.coalesce(F.sum("sum").over(along), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part", "source").orderBy("size", F.col("id").asc_nulls_first(), "th").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("inside", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(inside), F.lit(0)))
    met = near.join(ahead, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return met.select("id", "source", "th", "size", "n", "source_size", "target", (F.col("ahead") + F.col("inside") + offset(F.col("source"), seed)).alias("before"), "rate")


def _crossed(k0: object, k1: object) -> object:
    at = lambda k: F.shiftright(F.col("before") + k * F.col("rate"), PLACES)
    return at(k1) - at(k0)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix", **names: str) -> DataFrame:
    """(id, size, source_size, target, taken): one row a document with the words the mix takes of it.

    Null ids stand first and null sources last; empty texts have size 0 and take nothing.
    """
    sized = written(sizes(docs, **names), "mix-sizes")
    found = copies(sized, targets(sized, weights, most), seed)
    each = found.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return each.select("id", "size", "source_size", "target", (F.col("size") * _crossed(F.col("k") - 1, F.col("k"))).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: docs' columns, a row for each copy. Rows with the same id, source and text are interchangeable."""
    sized = written(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    found = copies(sized, targets(sized, weights, most), seed)
    n, i, h, m, o, c, k = (free_name(docs, f"_{x}") for x in ("null", "id", "th", "none", "source", "copies", "copy"))
    # keys without nulls, so that the texts' partitions serve both steps and texts are shuffled once
    plain = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    crossed = _crossed(F.lit(0).cast("long"), F.col("n"))
    many = found.select(F.col("id").isNull().alias(n), plain(F.col("id")).alias(i), F.col("th").alias(h), F.col("source").isNull().alias(m), plain(F.col("source")).alias(o), crossed.alias(c)).where(F.col(c) > 0)
    keys = [n, i, h, m, o]
    keyed = docs.select("*", F.col(id_col).isNull().alias(n), plain(F.col(id_col)).alias(i), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias(h), F.col(source_col).isNull().alias(m), plain(F.col(source_col)).alias(o))
    met = keyed.dropDuplicates(keys).join(many, keys)
    return met.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(c)))).select(*docs.columns)
