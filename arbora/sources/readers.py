"""Scans with declared schemas; a broken line is an error that names itself."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import is_probability
from ..functions.text import normalize_text
from ..schema import PROVENANCE, RECORD, SCORES

#: The project table's columns, and which of them are used.
PROJECT_CELLS, JOINED_CELL, TAIL_CELLS = 22, 15, 6
PROJECT_FIELDS = {"project_id": 0, "title": 3, "objective": 15, "human_validated": 20}


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """JSON lines, plain or gzip; blank lines are skipped, a line that is no object stops the job with its text."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_cells(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """(file, ord, cells) of delimited files, header left out: quoted cells may hold line ends, rows may be too long or short.

    A file is one task, as a quoted line end can only be told from its start; many files are many tasks.
    """
    return _cells(spark.read.format("binaryFile").load(path).select("path", "content"), sep)


def read_zip_member(spark: SparkSession, path: str, member: str, sha256: str | None = None, sep: str = ";") -> DataFrame:
    """(file, ord, cells) of one member of ZIP archives, never extracted to disk; a wrong archive hash is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if sha256:
        right = F.sha2("content", 256) == sha256
        files = files.withColumn("content", F.when(right, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("wrong archive: "), "path")).cast("binary")))

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [n for n in z.namelist() if n.rsplit("/", 1)[-1] == member]
                    if len(found) != 1:
                        raise ValueError(f"{name}: {len(found)} members named {member}")
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([z.read(found[0])], pa.binary())], names=["path", "content"])

    return _cells(files.mapInArrow(unzip, "path string, content binary"), sep)


def _cells(files: DataFrame, sep: str) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), delimiter=sep)
                next(rows, None)
                held: list[list[str]] = []
                ord_ = 0
                for row in rows:
                    held.append(row)
                    if len(held) == 2000:
                        yield _batch(name, ord_, held)
                        ord_, held = ord_ + len(held), []
                if held:
                    yield _batch(name, ord_, held)

    def _batch(name: str, at: int, rows: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["file", "ord", "cells"])

    return files.mapInArrow(parse, "file string, ord long, cells array<string>")


def repaired_cells(cells: Column | str, width: int = PROJECT_CELLS, joined: int = JOINED_CELL, tail: int = TAIL_CELLS, sep: str = ";") -> Column:
    """A row at its width: surplus cells were one cell that held the separator; a short row is null."""
    c = F.col(cells) if isinstance(cells, str) else cells
    middle = F.array(F.array_join(F.slice(c, F.lit(joined + 1), F.size(c) - joined - tail), sep))
    long = F.concat(F.slice(c, F.lit(1), F.lit(joined)), middle, F.slice(c, F.size(c) - tail + 1, F.lit(tail)))
    return F.when(F.size(c) == width, c).when(F.size(c) > width, long)


def projects(cells: DataFrame) -> DataFrame:
    """(ord, project fields, repair): repair is normal, repaired or malformed; malformed rows keep no field."""
    kind = F.when(F.size("cells") == PROJECT_CELLS, "normal").when(F.size("cells") > PROJECT_CELLS, "repaired").otherwise("malformed")
    fixed = cells.withColumn("_c", repaired_cells("cells"))
    return fixed.select("ord", *(F.get("_c", F.lit(i)).alias(n) for n, i in PROJECT_FIELDS.items()), kind.alias("repair"))


def assignments(cells: DataFrame) -> DataFrame:
    """(pid, code, title) of rows with five cells or more and neither code nor project blank."""
    at = lambda i: normalize_text(F.get("cells", F.lit(i)))
    return cells.where(F.size("cells") >= 5).select(at(4).alias("pid"), at(0).alias("code"), at(2).alias("title")).where("pid <> '' and code <> ''")


def codes_by_project(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pid").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.array_sort(F.collect_set("title")).alias("titles"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, parent, code ...) of a tree file; a child's code has to continue its parent's."""
    nodes = spark.read.option("multiLine", True).schema("labels array<struct<id:string,name:string,parent:string,euroscivoc_code:string,is_direct_supported:boolean,depth:int>>").json(path).select(F.explode("labels").alias("l")).select("l.*")
    up = nodes.select(F.col("id").alias("parent"), F.col("euroscivoc_code").alias("_up"))
    met = nodes.join(up, "parent", "left")
    good = F.col("_up").isNull() | F.col("euroscivoc_code").startswith(F.concat("_up", F.lit("/")))
    return met.withColumn("euroscivoc_code", F.when(good, F.col("euroscivoc_code")).otherwise(F.raise_error(F.concat(F.lit("code outside its parent: "), "id")))).drop("_up")


def read_scores(spark: SparkSession, path: str, member: str, eval_set: str, labels: list[str]) -> DataFrame:
    """(row, label, s) of one stored member and set; wrong lengths and scores outside 0 to 1 are errors. Floats widen before any comparison."""
    if len(set(labels)) != len(labels) or not all(x.strip() for x in labels):
        raise ValueError("labels are unique and not blank")
    raw = spark.read.schema(T.StructType([*SCORES.fields, T.StructField("member", T.StringType()), T.StructField("eval_set", T.StringType())])).parquet(path).where((F.col("member") == member) & (F.col("eval_set") == eval_set))
    whole = F.when(F.size("scores") == len(labels), F.col("scores")).otherwise(F.raise_error(F.lit("a row has the wrong number of scores")))
    names = F.array(*(F.lit(x) for x in labels))
    flat = raw.select(F.col("id").alias("row"), F.posexplode(whole).alias("k", "s")).select("row", F.element_at(names, F.col("k") + 1).alias("label"), F.col("s").cast("double").alias("s"))
    return flat.withColumn("s", F.when(is_probability("s"), F.col("s")).otherwise(F.raise_error(F.lit("a score is no probability"))))


def provenance_problems(stored: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """(field): fields of a score table's provenance row that differ from what is wanted."""
    fields = [f for f in PROVENANCE.fieldNames() if f in wanted]
    return stored.select(F.explode(F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.lit(wanted[f])), F.lit(f)) for f in fields)), lambda x: x.isNotNull())).alias("field"))


def union_sets(sets: Mapping[str, DataFrame]) -> DataFrame:
    """Score tables of several sets as one, with eval_set; repeated names are refused by the mapping itself."""
    out = None
    for name, df in sets.items():
        part = df.withColumn("eval_set", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sets")
    return out


def label_disagreements(scores: DataFrame, by: Sequence[str] = ("eval_set", "member")) -> DataFrame:
    """(by, label, have, of): labels that some rows of a set and member lack, and labels that other members score and one does not.

    scores has (by, row, label, s). have counts the rows with the label, of the rows of the group.
    """
    rows = scores.groupBy(*by).agg(F.count_distinct("row").alias("of"))
    every = rows.crossJoin(F.broadcast(scores.select("label").distinct()))  # groups and labels: a system's settings, not rows
    have = scores.groupBy(*by, "label").agg(F.count_distinct("row").alias("have"))
    return every.join(have, [*by, "label"], "left").fillna(0, ["have"]).where("have <> of").select(*by, "label", "have", "of")


def parse_sets(given: list[str]) -> dict[str, str]:
    """name=path arguments; a repeated name is an error."""
    out: dict[str, str] = {}
    for item in given:
        name, sep, path = item.partition("=")
        if not sep or not name or not path or name in out:
            raise ValueError(f"bad or repeated set: {item}")
        out[name] = path
    return out


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text) of JSON lines for inference: each line that is not blank is an object with a text that is not; an error names the line."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    text = F.get_json_object("value", "$.text")
    good = text.isNotNull() & (normalize_text(text) != "")
    return lines.select(F.when(good, text).otherwise(F.raise_error(F.concat(F.lit("no text in: "), F.substring("value", 1, 80)))).alias("text"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files, recursively."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def artifact_fingerprint(files: DataFrame) -> DataFrame:
    """One row: a hash over the sorted names and hashes of files."""
    return files.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")))), 256).alias("artifact_sha256"), F.sum("bytes").alias("bytes"))
