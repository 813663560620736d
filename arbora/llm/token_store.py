"""Token ids of a corpus in directly addressable codes (DAC).

An id is cut into chunks of CHUNK bits, lowest first. Level k holds the k-th chunks of all ids that have
one, with a continuation bitmap: a set bit says that the id goes on in the next level, at the rank of
that bit. A rank directory (set bits before each RANK bits) makes ranks, and so any single token, a
constant-time lookup without decoding a block.

A file image (one row of the store's table) is a run of whole documents in ascending id order:
magic, counts, document bounds, then per level its size, chunks, bitmap and directory. Images are written
as rows of Parquet in the shared folder by Spark's own committer, so a lost task leaves nothing behind. They
are not compressed, have a row group each, and at most FILE_IMAGES share a file, so a lookup reads the
slim columns and, of the files it needs, the images it needs.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, whole_number, written

MAGIC = b"ARBDAC01"
CHUNK, RANK = 8, 512
#: Tokens of a file image aimed at; a longer document has an image of its own.
IMAGE_TOKENS = 1 << 20
FILE_IMAGES = 64
#: A row group ends after the first image that brings it to so many bytes.
GROUP_BYTES = 1 << 16
#: Files that a lookup names to the reader; one that needs more reads the index of all.
NAMED_FILES = 1000
#: Text pieces whose ids a Python worker remembers, and words in them; then it begins anew. Kept from task to task, of one
#: vocabulary file at a time. Longer pieces and words are encoded but not remembered, so the number bounds the bytes.
REMEMBERED = 500_000
REMEMBERED_LENGTH = 48
END_ID = 0


# ---------------------------------------------------------------- codes


@dataclass
class Level:
    chunks: np.ndarray
    bitmap: np.ndarray
    directory: np.ndarray

    def goes_on(self, i: int) -> bool:
        return bool(self.bitmap[i >> 3] >> (i & 7) & 1)

    def rank(self, i: int) -> int:
        """Set bits before i."""
        block = i // RANK
        at, count = block * (RANK >> 3), int(self.directory[block])
        count += int(np.bitwise_count(self.bitmap[at : i >> 3]).sum())
        return count + (int(self.bitmap[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else count


@dataclass
class Image:
    """Decoded frame of a file image; tokens stay in their levels."""

    doc_ids: list[int | None]
    bounds: np.ndarray
    levels: list[Level]

    def __len__(self) -> int:
        return int(self.bounds[-1])

    def token(self, i: int) -> int:
        """The i-th id, by one rank a level."""
        out, shift = 0, 0
        for level in self.levels:
            out |= int(level.chunks[i]) << shift
            if not level.goes_on(i):
                return out
            i, shift = level.rank(i), shift + CHUNK
        return out

    def all(self) -> np.ndarray:
        """All ids, level by level from the last."""
        upper = np.zeros(0, np.uint32)
        for level in reversed(self.levels):
            out = level.chunks.astype(np.uint32)
            if len(upper):
                out[np.unpackbits(level.bitmap, count=len(out), bitorder="little").view(bool)] |= upper << np.uint32(CHUNK)
            upper = out
        return upper

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi - 1, by one rank a level at each end."""
        out = np.zeros(max(0, hi - lo), np.uint32)
        where: np.ndarray | slice = slice(None)
        for k, level in enumerate(self.levels):
            if hi <= lo:
                break
            out[where] |= level.chunks[lo:hi].astype(np.uint32) << np.uint32(k * CHUNK)
            bits = np.unpackbits(level.bitmap[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 : (lo & 7) + hi - lo].astype(bool)
            index = np.arange(len(out)) if isinstance(where, slice) else where
            where = index[bits]
            lo = level.rank(lo)
            hi = lo + len(where)
        return out


def encode_levels(ids: np.ndarray) -> list[Level]:
    rest, out = ids.astype(np.uint32, copy=False), []
    while True:
        more = rest >> np.uint32(CHUNK)
        on = more > 0
        bitmap = np.packbits(on, bitorder="little")
        padded = np.zeros(-(-max(len(on), 1) // RANK) * (RANK >> 3), np.uint8)
        padded[: len(bitmap)] = bitmap
        counts = np.bitwise_count(padded).reshape(-1, RANK >> 3).sum(1, dtype=np.uint64)
        directory = np.concatenate((np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)))
        out.append(Level((rest & np.uint32((1 << CHUNK) - 1)).astype(np.uint8), bitmap, directory))
        rest = more[on]
        if not len(rest):
            return out


def to_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    levels = encode_levels(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    bounds = np.concatenate(([0], np.cumsum(np.array(lengths, np.uint64), dtype=np.uint64)))
    parts = [MAGIC, struct.pack("<QQI", len(doc_ids), len(ids), len(levels)), known.tobytes(), np.array([d or 0 for d in doc_ids], np.int64).tobytes(), bounds.astype(np.uint64).tobytes()]
    for level in levels:
        parts += [struct.pack("<Q", len(level.chunks)), level.chunks.tobytes(), level.bitmap.tobytes(), level.directory.astype("<u8").tobytes()]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def from_image(image: bytes, checked: bool = True) -> Image:
    if image[:8] != MAGIC or (checked and struct.unpack("<I", image[-4:])[0] != zlib.crc32(image[:-4])):
        raise ValueError("not a whole token image")
    docs, tokens, depth = struct.unpack_from("<QQI", image, 8)
    at = 28

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, kind, n, at)
        at += out.nbytes
        return out

    known, numbers, bounds = take("u1", docs), take("<i8", docs), take("<u8", docs + 1)
    levels = []
    for _ in range(depth):
        (n,) = struct.unpack_from("<Q", image, at)
        at += 8
        levels.append(Level(take("u1", n), take("u1", (n + 7) // 8), take("<u8", -(-max(n, 1) // RANK) + 1)))
    return Image([int(d) if k else None for k, d in zip(known, numbers, strict=True)], bounds, levels)


# ---------------------------------------------------------------- tokens


class OddSpace(Exception):
    """A piece holds white space other than spaces and line ends."""


class Pieces(dict):
    """Text piece -> its ids as little-endian bytes; a key lacks the space before it, unless a line end comes first.

    The pre-tokenizer of a byte-level BPE never joins a token over the border before a run of spaces and line
    ends, so such pieces encode on their own. Words of Latin letters with the signs after them go straight to the
    library's model, each word once; all others to its full encode. Texts whose spaces and line ends stand alone
    are cut at spaces, others by a pattern; a text with any other white space is encoded whole.
    """

    cut = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
    odd = re.compile(r"[^\S \n]")
    word = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([^\\w\\s']*)\\Z")

    def __init__(self, file: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        before = json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}
        self.plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and self.tokenizer.normalizer is None
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.letters = bytes_as_letters()
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, word: str) -> bytes:
        """Ids of what is one pre-token."""
        out = self.words.get(word)
        if out is None:
            mapped = word.replace(" ", "Ġ") if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            out = array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if len(word) <= REMEMBERED_LENGTH:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = out
        return out

    def __missing__(self, key: str) -> bytes:
        if found := self.word.match(key):
            word, signs = found.groups()
            out = self.of(" " + word)
            if signs:
                out += self.of(signs)
        elif self.odd.search(key):
            raise OddSpace
        else:
            out = self.whole(key if key[:1] == "\n" else " " + key)
        if len(key) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
                self.words.clear()
            self[key] = out
        return out

    def ids(self, text: str) -> bytes:
        """All ids of a text as the library's encode gives them."""
        if not self.plain:
            return self.whole(text)
        try:
            if "  " not in text and "\n\n" not in text and " \n" not in text:
                first, *rest = text.replace("\n", " \n").split(" ")
                head = self.whole(first) if first else b""
            else:
                # a piece with a space before it is known without; one without is encoded as it is
                parts = self.cut.findall(text)
                return b"".join(self[x[1:]] if x[0] == " " and x[1:2] not in (" ", "\n") else self.whole(x) if not self.odd.search(x) else self[x] for x in parts)
            return head + b"".join(map(self.__getitem__, rest))
        except OddSpace:
            return self.whole(text)


_kept: dict[str, Pieces] = {}


def pieces_of(file: str) -> Pieces:
    """The worker's pieces for a vocabulary file."""
    if file not in _kept:
        _kept.clear()
        _kept[file] = Pieces(file)
    return _kept[file]


def bytes_as_letters() -> dict[int, str]:
    """The byte-level alphabet: bytes that do not print stand for characters from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(256 + k) for k, b in enumerate(others)}


def write_store(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, image_tokens: int = IMAGE_TOKENS) -> None:
    """Writes docs in ascending id order (null ids first, repeated ids side by side) as file images under path.

    Each row is one image: part and seq order the images, n_tokens counts their ids. Null text is empty:
    its document is the end id alone. Ids are longs; one that is no whole number is an error. No documents write
    no image. Texts are range-partitioned before they are encoded, once.
    """
    bounded_batches(docs.sparkSession)
    named = docs.select(whole_number(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    placed = named.repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        pieces = pieces_of(tokenizer)
        kind = np.dtype(pieces.kind)
        end = np.array([end_id], kind).tobytes()
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        count = 0

        def image() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), kind)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([to_image(doc_ids, lengths, ids)], pa.binary())],
                names=["part", "seq", "n_tokens", "n_docs", "image"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = pieces.ids(text) + end
                n = len(made) // kind.itemsize
                if doc_ids and count + n > image_tokens:
                    yield image()
                    doc_ids, lengths, held, count, seq = [], [], [], 0, seq + 1
                doc_ids.append(doc)
                lengths.append(n)
                held.append(made)
                count += n
        if doc_ids:
            yield image()

    made = placed.mapInArrow(encode, "part int, seq int, n_tokens long, n_docs long, image binary")
    a_row_group_each = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    made.write.options(compression="uncompressed", maxRecordsPerFile=FILE_IMAGES, **a_row_group_each).parquet(path)


def read_store(docs_from: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from a table of file images."""
    slim = docs_from.select("part", "seq", "n_tokens")
    parts = slim.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = slim.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(ahead, F.col("part") == F.col("p")).select("part", "seq", (F.col("ahead") + F.col("inside")).alias("first"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image = from_image(batch.column(2)[k].as_py())
                ids, bounds = image.all().astype("<u4"), image.bounds.astype(np.int64)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[k].as_py()] * n, pa.int32()), pa.array([batch.column(1)[k].as_py()] * n, pa.int32()), pa.array(image.doc_ids, pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())],
                    names=["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    found = docs_from.select("part", "seq", "image").mapInArrow(decode, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def image_spans(store: DataFrame) -> DataFrame:
    """(part, seq, n_tokens, first, file): where each image begins in the corpus; reads no image."""
    slim = store.select("part", "seq", "n_tokens", F.col("_metadata.file_path").alias("file"))
    images = slim.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = images.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return slim.join(ahead, "part").select("part", "seq", "n_tokens", (F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("first"), "file")


def images_wanted(store: DataFrame, positions: DataFrame) -> DataFrame:
    """(part, seq, file, wanted): the images that hold the positions, with their places in each; written."""
    step = F.lit(IMAGE_TOKENS)
    cells = image_spans(store).withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / step), F.floor((F.col("first") + F.col("n_tokens") - 1) / step))))
    met = positions.select("position").where("position is not null").withColumn("cell", F.floor(F.col("position") / step)).join(cells, "cell").where("position >= first and position < first + n_tokens")
    return written(met.groupBy("part", "seq", "file").agg(F.collect_list(F.struct("position", (F.col("position") - F.col("first")).alias("at"))).alias("wanted")), "tokens-wanted")


def tokens_at(store: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, token) for a table of corpus positions: each is one lookup in its image, no block is decoded.

    store is read from the files of write_store. Positions outside the corpus, and null ones, have no row.
    """
    per = images_wanted(store, positions)
    files = [r["file"] for r in per.select("file").distinct().limit(NAMED_FILES + 1).collect()]
    named = store.where(F.col("_metadata.file_path").isin(files)) if len(files) <= NAMED_FILES else store

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, wanted_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = from_image(raw, checked=False)
                yield pa.RecordBatch.from_arrays([pa.array([w["position"] for w in wanted_], pa.int64()), pa.array([image.token(w["at"]) for w in wanted_], pa.int64())], names=["position", "token"])

    return named.join(per.drop("file"), ["part", "seq"]).select("image", "wanted").mapInArrow(look, "position long, token long")


def stored(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs' ids to a store in the shared folder and reads every document back from it."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_store(docs, path, tokenizer, id_col, text_col)
    return read_store(spark.read.schema("part int, seq int, n_tokens long, n_docs long, image binary").parquet(path))
