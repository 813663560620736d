"""Line dedup by winnowing over line hashes.

A run of lines counts as a repeat from MIN_WORDS words on. A window is a shortest run of so many words: from each
line forward, and to each line backward. Winnowing selects in each window its smallest line hash (the last of
equal ones) and that hash's position; neighbouring windows mostly select the same position, so a
document has few. A repeated run holds a window whole, whose copy selects the same hash at the same
place in it: no repeat goes unseen.

1. Positions are joined on their hash. Those whose hash no other position has are done with.
2. The windows around the others are compared whole: a window's place is matched with the first place of the
   same lines (ids ascending, then text hash, then line), never with all others, so a line that a third of
   all documents share makes one row a place and no pairs.
3. Matches with one partner on one diagonal are extended both ways: forward windows reach the left end of a
   repeated run and backward windows its right end, and those that touch are one match. Any line of any
   repeated run of MIN_WORDS words lies in such a window inside the run, so nothing of it is left over.
4. The later run is deleted.

Equal texts are one document here: of copies, the one with the smallest id is compared, and the whole of the
others is a repeat if it has MIN_WORDS words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, free_name, starts_of, text_bytes, written

MIN_WORDS = 50


def line_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, hashes, words) of the lines that have a word; white space at their ends does not count."""
    number, code, words = [], [], []
    for k, line in enumerate(text.split(b"\n")):
        if n := len(line.split()):
            number.append(k)
            code.append(xxhash.xxh64_intdigest(line.strip()))
            words.append(n)
    return np.array(number, np.int32), np.array(code, np.uint64), np.array(words, np.int32)


def windows(words: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(first line, end) of the shortest runs with min_words words, from each line forward and to each line backward."""
    ends = starts_of(words)
    n = len(words)
    stop = np.searchsorted(ends, ends[:n] + min_words)
    forward = np.flatnonzero(stop <= n)
    start = np.searchsorted(ends, ends[1:] - min_words, "right") - 1
    backward = np.flatnonzero(start >= 0)
    found = set(zip(forward.tolist(), stop[forward].tolist(), strict=True))
    return sorted(found | set(zip(start[backward].tolist(), (backward + 1).tolist(), strict=True)))


def selected(code: np.ndarray, words: np.ndarray, min_words: int = MIN_WORDS) -> dict[int, list[tuple[int, int, int]]]:
    """Selected position -> (hash of the lines, first line, lines) of the windows that select it."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in windows(words, min_words):
        part = code[a:b]
        at = a if b - a == 1 else b - 1 - int(part[::-1].argmin())
        out.setdefault(at, []).append((xxhash.xxh64_intdigest(part.tobytes()), a, b - a))
    return out


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (first, end) that overlap or touch, as one each, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, n_lines, n_words, numbers, code, words): the lines of each row's text; code and words are packed."""
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("n_lines", T.IntegerType()), T.StructField("n_words", T.LongType()), T.StructField("numbers", T.ArrayType(T.IntegerType())), T.StructField("code", T.BinaryType()), T.StructField("words", T.BinaryType())]
    )
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.col(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        texts = text_bytes(batch.column(2))
        made = [line_hashes(x) for x in texts]
        numbers = pa.ListArray.from_arrays(pa.array(starts_of(np.array([len(m[0]) for m in made])).astype(np.int32)), pa.array(np.concatenate([m[0] for m in made])))
        return {
            "id": batch.column(0), "th": batch.column(1), "n_lines": pa.array([x.count(b"\n") + 1 for x in texts], pa.int32()), "n_words": pa.array([int(m[2].sum()) for m in made], pa.int64()),
            "numbers": numbers, "code": pa.array([m[1].tobytes() for m in made], pa.binary()), "words": pa.array([m[2].tobytes() for m in made], pa.binary()),
        }

    return arrow_pass(named, ["id", "th", "text"], schema, work)


def _positions(once: DataFrame, min_words: int) -> DataFrame:
    """(id, th, h, windows): a row for each selected position, h the line hash there."""
    window = T.StructType([T.StructField("c", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())])
    schema = T.StructType([T.StructField("id", once.schema["id"].dataType), T.StructField("th", T.LongType()), T.StructField("h", T.LongType()), T.StructField("windows", T.ArrayType(window))])

    def work(batch: pa.RecordBatch) -> dict:
        rows: list[int] = []
        marks: list[int] = []
        sizes: list[int] = []
        found: list[tuple[int, int, int]] = []
        for row, (packed, counts) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            code = np.frombuffer(packed.as_py(), np.uint64)
            for at, around in selected(code, np.frombuffer(counts.as_py(), np.int32), min_words).items():
                rows.append(row)
                marks.append(int(code[at]))
                sizes.append(len(around))
                found += around
        made = np.array(found, np.uint64).reshape(-1, 3)
        kind = pa.struct([("c", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
        flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(made[:, 0]).view(np.int64)), pa.array(made[:, 1].astype(np.int32)), pa.array(made[:, 2].astype(np.int32))], fields=list(kind))
        index = pa.array(rows, pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(starts_of(np.array(sizes, np.int64)).astype(np.int32)), flat)
        return {"id": batch.column(0).take(index), "th": batch.column(1).take(index), "h": pa.array(np.array(marks, np.uint64).view(np.int64)), "windows": lists}

    return arrow_pass(once, ["id", "th", "code", "words"], schema, work)


def _matches(once: DataFrame, min_words: int) -> DataFrame:
    """(th, id, from_id, from_th, shift, at, n): later windows, and the first place of the same lines at line at + shift."""
    places = written(_positions(once, min_words), "line-positions")
    shared = places.groupBy("h").agg(F.count("*").alias("places")).where("places > 1").select("h")
    # a hash that recurs only in its own document counts as well: each position is a row
    alive = places.join(shared, "h").select("id", "th", "h", F.explode("windows").alias("w")).select("id", "th", "h", "w.*")
    alive = written(alive, "line-windows")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "th", "at")
    first = alive.groupBy("h", "c", "n").agg(F.min(order).alias("first"), F.count("*").alias("places")).where("places > 1").drop("places")
    later = alive.join(first, ["h", "c", "n"]).where(order > F.col("first"))
    return later.select("th", "id", F.col("first.id").alias("from_id"), F.col("first.th").alias("from_th"), (F.col("first.at") - F.col("at")).alias("shift"), "at", "n")


def _extended(matches: DataFrame) -> DataFrame:
    """(th, id, from_id, from_th, shift, lo, hi): matches of one diagonal joined to runs of lines lo to hi - 1."""
    keys = ["th", "id", "from_id", "from_th", "shift"]
    packed = matches.groupBy(*keys).agg(F.collect_list(F.struct("at", "n")).alias("spans"))  # a document's own lines bound it
    schema = T.StructType([*(matches.schema[k] for k in keys), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])

    def work(batch: pa.RecordBatch) -> dict:
        rows: list[int] = []
        runs: list[tuple[int, int]] = []
        for row, spans in enumerate(batch.column(5).to_pylist()):
            made = joined_spans([(s["at"], s["at"] + s["n"]) for s in spans])
            rows += [row] * len(made)
            runs += made
        index = pa.array(rows, pa.int64())
        made_ = np.array(runs, np.int32).reshape(-1, 2)
        return {**{k: batch.column(i).take(index) for i, k in enumerate(keys)}, "lo": made_[:, 0], "hi": made_[:, 1]}

    return arrow_pass(packed, [*keys, "spans"], schema, work)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(all rows' lines, one row a distinct text with its smallest id), both written."""
    lines = written(_lines(docs, id_col, text_col), "lines")
    once = lines.groupBy("th").agg(F.min("id").alias("id"), F.first("code").alias("code"), F.first("words").alias("words"), F.first("numbers").alias("numbers"))
    return lines, written(once, "line-texts")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_line, last_line, from_id, from_line): the repeated runs of distinct texts and where they stand first.

    Lines count from 0. A text with copies stands under its smallest id.
    """
    _, once = _documents(docs, id_col, text_col)
    runs = _extended(_matches(once, min_words))
    mine = once.select("th", F.col("numbers").alias("own"))
    theirs = once.select(F.col("th").alias("from_th"), F.col("numbers").alias("other"))
    met = runs.join(mine, "th").join(theirs, "from_th")
    return met.select("id", F.expr("own[lo]").alias("first_line"), F.expr("own[hi - 1]").alias("last_line"), "from_id", F.expr("other[lo + shift]").alias("from_line"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, n_lines, removed): the numbers from 0 of the lines that repeat an earlier run, ascending.

    A run is earlier in a document of a smaller id (null ids last; of one id, of the smaller text hash th), or
    further up in the same document, overlaps included. A null text has one empty line; blank lines stay and do
    not part a run. Rows with the same id and text count as one document, and each has its row. Texts are
    told apart by 64-bit hashes, runs by two of them (of all lines, and of the selected one) and their number of lines.
    """
    lines, once = _documents(docs, id_col, text_col)
    runs = _extended(_matches(once, min_words))
    gone = runs.groupBy("th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(lo, hi - 1)"))))).alias("gone"))  # a document's own lines bound it
    told = once.select("th", F.col("id").alias("first")).join(gone, "th", "left")
    copy_ = F.when(F.col("n_words") >= min_words, F.col("numbers"))
    removed = F.when(F.col("id").eqNullSafe(F.col("first")), F.transform("gone", lambda k: F.get("numbers", k))).otherwise(copy_)
    return lines.join(told, "th").select("id", "th", "n_lines", F.coalesce(removed, F.array().cast("array<int>")).alias("removed"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated later lines deleted from their texts; a document may become empty, and stays."""
    i, t, g, h = (free_name(docs, f"_{x}") for x in ("i", "t", "gone", "th"))
    found = repeated_lines(docs, min_words, id_col, text_col).where(F.size("removed") > 0)
    gone = found.select(F.col("id").alias(i), F.col("th").alias(t), F.col("removed").alias(g)).dropDuplicates([i, t])
    kept = F.filter(F.transform(F.split(text_col, "\n", -1), lambda x, k: F.when(~F.array_contains(g, k), x)), lambda x: x.isNotNull())
    met = docs.withColumn(h, F.xxhash64(F.coalesce(text_col, F.lit("")))).join(gone, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(h) == F.col(t)), "left")
    cut = F.when(F.col(g).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return met.select(*(cut.alias(c) if c == text_col else F.col(c) for c in docs.columns))
