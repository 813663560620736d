"""WARC archives: written with revisit records, read back by boundary-chain verification.

A record's header names its length, and so where its successor starts. Archives are read in blocks, many a file
and each by a task of its own that sees no other block: Spark's text reader cuts files at line ends, and a line
end here is the break and magic between records. So every line is a candidate record, inside payloads too. A
task knows offsets only from its block's first line on; the lengths of the blocks before it, summed along the file,
make them offsets of the file. Each candidate names its successor's offset. Pointer jumping from offset 0 of each
file finds the offsets at which the true chain enters each block; only candidates on the way from such an entry
are records.

Within a block the task has already followed the chains: a candidate's parent is its successor, and
the numbers (tin, tout) of a walk through that forest tell whether a candidate lies on the way
from an entry. So pointer jumping handles one offset a block, in a number of rounds that grows with the
logarithm of the blocks of a file. A record that goes on in another block is put together again from its
lines, once it is known to be one.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, new_path, text_bytes, written

MAGIC, BREAK = b"WARC/1.", b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: What parts one candidate from the next.
PARTED = BREAK + MAGIC
#: Bytes of an archive file aimed at. Blocks of it are as long as Spark's spark.sql.files.maxPartitionBytes.
FILE_BYTES = 32 << 20
#: Pages whose heads payloads on their way are compressed against.
SHARED_PAGES = 128
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: object) -> object:
    """Bare upper-case base32 of the SHA-1 of a binary column."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record without the line breaks that end it; payload is not written for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + BREAK + block


def write_archives(pages: DataFrame, path: str, at_least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes pages (page_id, url, html) as WARC files under path.

    Of pages with equal payloads of at_least bytes or more, the smallest page_id is a response and the
    others revisit it. A null html is an empty payload, a null url has no target. Rows that repeat
    one page_id with one payload are responses alike; a null page_id is never referred to, and groups
    without any page_id are responses.
    """
    bounded_batches(pages.sparkSession)
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    known = named.withColumn("payload", F.encode("html", "UTF-8")).select("page_id", "url", "payload", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    slim = known.select("page_id", "digest", "size")
    first = slim.where(F.col("size") >= at_least).groupBy("digest").agg(F.min("page_id").alias("first"))
    told = slim.distinct().join(first, "digest", "left").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first")

    common = b"".join(bytes(r[0]) for r in known.select(F.substring("payload", 1, 4096)).limit(SHARED_PAGES).collect())  # at most 512 KB

    def shared() -> dict:
        return {"dict_data": zstandard.ZstdCompressionDict(common, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if common else {}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, **shared()).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([squeeze(x) for x in text_bytes(b.column(2))], pa.binary()), b.column(3), b.column(4)], names=["page_id", "url", "packed", "digest", "size"])

    # payloads are shuffled once, compressed against the heads of some pages
    packed = known.mapInArrow(pack, "page_id long, url string, packed binary, digest string, size long")
    met = packed.join(told, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))).select("page_id", "url", "packed", "digest", "size", "first")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(**shared()).decompress
        for b in batches:
            page, url, packed_, digest, size, first_ = (b.column(i).to_pylist() for i in range(6))
            made = []
            for p, u, z, d, n, f in zip(page, url, packed_, digest, size, first_, strict=True):
                again = f is not None and p != f
                made.append(record(p, u, b"" if again or not n else unpack(z, max_output_size=n), n, d, f, again))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    total = known.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    each = max(1, int(file_bytes * max(total["n"], 1) / max((total["bytes"] or 0) + 500 * total["n"], 1)))
    records = met.mapInArrow(compose, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", BREAK.decode()).option("maxRecordsPerFile", each).text(path)


def header_of(content: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """(fields, start of the block, length of the block) of a record; None if content does not start as one."""
    if not _VERSION.match(content):
        return None
    end = content.find(BREAK)
    end = len(content) if end < 0 else end  # the break is then part of what parts it from the next candidate
    lines = content[:end].split(b"\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    length = fields.get(b"content-length", b"")
    return (fields, end + 4, int(length)) if re.fullmatch(rb"\d{1,18}", length) else None


def chained(offsets: list[int], successors: list[int]) -> list[tuple[int, int, int]]:
    """(exit, tin, tout) of each candidate of a block; exit is the first offset beyond the block on its chain."""
    at = {o: i for i, o in enumerate(offsets)}
    below: list[list[int]] = [[] for _ in offsets]
    roots = []
    for i, s in enumerate(successors):
        (below[at[s]] if s in at and s > offsets[i] else roots).append(i)
    out: list[list[int]] = [[0, 0, 0] for _ in offsets]
    clock = 0
    for root in roots:
        stack = [(root, False)]
        while stack:
            i, done = stack.pop()
            if done:
                out[i][2] = clock
                continue
            clock += 1
            out[i][0], out[i][1] = successors[root], clock
            stack.append((i, True))
            stack += [(j, False) for j in below[i]]
    return [tuple(x) for x in out]


_TOLD = "page_id long, payload_bytes long, payload_digest string, stated_digest string, record_type string, refers_to long, url string"
_SCHEMA = f"file string, block long, off long, succ long, exit long, tin long, tout long, whole boolean, {_TOLD}"
_KINDS = [pa.string(), *[pa.int64()] * 6, pa.bool_(), *[pa.int64()] * 2, *[pa.string()] * 3, pa.int64(), pa.string()]
_IDENT = re.compile(rb"<urn:page:(-?\d+)>")


def candidate_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line): the archives cut before each magic that follows a break; block is where a task's part starts."""
    read = spark.read.option("lineSep", PARTED.decode()).option("recursiveFileLookup", "true").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


class Block:
    """What a task has met of one block of a file: candidates, and those that want more bytes than their line has."""

    def __init__(self, file: str, start: int) -> None:
        self.file, self.start, self.at, self.rows, self.open = file, start, 0, [], []

    def meet(self, line: bytes) -> None:
        """The next line, at self.at after the first line of the block; its magic stands before it, but for a file's first."""
        first = self.start == 0 and self.at == 0
        content, off = (line, 0) if first else (MAGIC + line, self.at - len(MAGIC))
        self.at += len(line) + len(PARTED)
        for held in self.open:
            held[2].append(content)
            held[3] += len(content) + len(BREAK)
        if found := header_of(content):
            fields, start, length = found
            self.open.append([off, off + start + length + len(BREAK), [content], len(content) - start, fields, start, length])
        still = []
        for held in self.open:
            have, length = held[3], held[6]
            if have < length:
                still.append(held)
                continue
            record_ = BREAK.join(held[2])
            body, rest = record_[held[5] : held[5] + length], record_[held[5] + length :]
            if not rest or rest[:4] == BREAK:  # parted from the next candidate, or at the end of the file
                self.rows.append((held[0], held[1], True, *_told(held[4], body)))
        self.open = still

    def done(self) -> list[tuple]:
        """Rows of _SCHEMA: the candidates by offset, and one without offset whose successor is the bytes of the lines."""
        rows = self.rows + [(h[0], h[1], False, *_told(h[4], b"")) for h in self.open]
        rows.sort(key=lambda r: r[0])
        walks = chained([r[0] for r in rows], [r[1] for r in rows])
        out = [(self.file, self.start, r[0], r[1], *walk, *r[2:]) for r, walk in zip(rows, walks, strict=True)]
        return [*out, (self.file, self.start, None, self.at, *[None] * 11)]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place of the archives that reads as a record's start, with what its header and block say.

    Offsets count from the first line of the block. A candidate that goes on beyond the last line of its block is
    not whole; its payload is not looked at.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block | None = None

        def told(block: Block) -> pa.RecordBatch:
            columns = zip(*block.done(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

        for b in batches:
            for file, start, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if block is None or (block.file, block.start) != (file, start):
                    if block is not None:
                        yield told(block)
                    block = Block(file, start)
                block.meet(line.as_py())
        if block is not None:
            yield told(block)

    return candidate_lines(spark, path).mapInArrow(scan, _SCHEMA)


def block_bases(found: DataFrame) -> DataFrame:
    """(f, b, base): the offset in its file of each block's first line, a prefix sum over the blocks of a file."""
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return found.where("off is null").select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("succ").over(along), F.lit(0)).alias("base"))


def _told(fields: dict[bytes, bytes], body: bytes) -> tuple:
    page, refers = _IDENT.match(fields.get(b"warc-record-id", b"")), _IDENT.match(fields.get(b"warc-refers-to", b""))
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    stated = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
    head, _, payload = body.partition(BREAK)
    if kind == "revisit":
        told = re.search(rb"(?i)content-length:\s*(\d{1,18})", head)
        size, digest = int(told[1]) if told else None, stated
    else:
        size, digest = len(payload), b32encode(hashlib.sha1(payload).digest()).decode()
    url = fields.get(b"warc-target-uri")
    return (int(page[1]) if page else None, size, digest, stated, kind, int(refers[1]) if refers else None, url.decode("utf-8", "replace") if url is not None else None)


def _put_together(spark: SparkSession, path: str, parted: DataFrame, bases: DataFrame) -> DataFrame:
    """(file, off, what _told says): records that lie in more than one block, from all their lines in order."""
    wide = parted.select(F.col("file").alias("pf"), F.col("off").alias("po"), "succ")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, at = None, 0
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            spots = []
            for key, line in zip(keys, b.column(2), strict=True):
                at = 0 if key != seen else at
                seen = key
                spots.append(at)
                at += len(line.as_buffer()) + len(PARTED)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spots, pa.int64())], names=["file", "block", "line", "at"])

    met = candidate_lines(spark, path).mapInArrow(placed, "file string, block long, line binary, at long").join(bases, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    start = F.col("base") + F.col("at")
    off = F.when(start == 0, start).otherwise(start - len(MAGIC))
    held = met.select("file", off.alias("off"), "line").join(wide, (F.col("file") == F.col("pf")) & (F.col("off") >= F.col("po")) & (F.col("off") < F.col("succ")))
    packed = held.groupBy("pf", "po").agg(F.sort_array(F.collect_list(F.struct("off", "line"))).alias("lines"))  # one record's own bytes

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, off_, lines_ in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                content = BREAK.join(x["line"] if x["off"] == 0 else MAGIC + x["line"] for x in lines_)
                fields, at, length = header_of(content)
                rest = content[at + length :]
                if len(content) < at + length or (rest and rest[:4] != BREAK):
                    raise ValueError(f"the record at {off_} of {file} does not end where its header says")
                rows.append((file, off_, *_told(fields, content[at : at + length])))
            kinds = [pa.string(), pa.int64(), *_KINDS[8:]]
            names = ["file", "off", *(x.split()[0] for x in _TOLD.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return packed.mapInArrow(tell, f"file string, off long, {_TOLD}")


def read_archives(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """The true records of all archives under path: candidates that the chain from each file's start reaches.

    A chain that breaks off hides the rest of its file; with whole, that is an error.
    """
    bounded_batches(spark)
    found = written(candidates(spark, path), "warc-candidates")
    bases = written(block_bases(found), "warc-blocks")
    based = found.where("off is not null").join(bases, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b")
    based = based.select("file", "block", *((F.col(c) + F.col("base")).alias(c) for c in ("off", "succ", "exit")), "tin", "tout", "whole", *(x.split()[0] for x in _TOLD.split(", ")))
    chain = written(based.select("file", "block", "off", "exit", "tin"), "warc-chain")
    edges = chain.select("file", "off", "exit").distinct()
    zero = edges.where("off = 0").select("file", F.col("off").alias("at"))
    # only offsets where some chain leaves a block, or a file starts, can be entries
    aims = chain.select("file", F.col("exit").alias("off")).unionByName(chain.where("off = 0").select("file", "off")).distinct()
    jump = written(edges.join(aims, ["file", "off"], "left_semi"), "warc-jumps")
    reach = written(zero, "warc-reach")
    count = reach.count()
    while count:
        over = reach.join(jump, (reach["file"] == jump["file"]) & (reach["at"] == jump["off"])).select(reach["file"], F.col("exit").alias("at"))
        more = written(reach.unionByName(over).distinct(), "warc-reach")
        now = more.count()
        dropped(reach)
        reach = more
        if now == count:
            break
        count = now
        far = jump.select(F.col("file").alias("f"), F.col("off").alias("o"), F.col("exit").alias("e"))
        twice = written(jump.join(far, (F.col("file") == F.col("f")) & (F.col("exit") == F.col("o"))).select("file", "off", F.col("e").alias("exit")), "warc-jumps")
        dropped(jump)
        jump = twice
    if whole:
        sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select(F.col("path").alias("file"), F.col("length").alias("at"))
        if broken := sizes.join(reach, ["file", "at"], "left_anti").limit(3).collect():
            raise ValueError(f"the chain of records breaks off before the end of {', '.join(r['file'] for r in broken)}")
    entries = reach.join(chain.select("file", "block", "off", F.col("tin").alias("entry")), (reach["file"] == chain["file"]) & (reach["at"] == chain["off"])).select(chain["file"].alias("f"), F.col("block").alias("b"), "entry").distinct()
    kept = based.join(entries, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")) & (F.col("tin") <= F.col("entry")) & (F.col("tout") >= F.col("entry")))
    columns = ["file", "off", "succ", "page_id", "url", "payload_bytes", "payload_digest", "stated_digest", "record_type", "refers_to"]
    parted = written(kept.where("not whole").select("file", "off", "succ"), "warc-parted")
    inside = kept.where("whole").select(*columns)
    if parted.isEmpty():
        return inside
    return inside.unionByName(_put_together(spark, path, parted, bases).join(parted, ["file", "off"]).select(*columns))


def archived(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads their records back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, at_least)
    return read_archives(pages.sparkSession, path, whole=True)
