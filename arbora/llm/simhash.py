"""SimHash fingerprints and near-duplicate groups found with pivot distance tables.

Two fingerprints can differ in at most `radius` bits only if their Hamming distances to every
reference fingerprint (pivot) differ by at most `radius`. Reference distances are used twice:

* Blocking. The distances to the zero fingerprint and to the 64 one-bit fingerprints determine each
  bit of a fingerprint, so a block of bits is a cell of reference coordinates. With m blocks, a pair
  within `radius` agrees exactly on at least m - radius of them, so equal keys over every choice of
  m - radius blocks meet every such pair. m grows with the number of distinct fingerprints.
* Discarding. Each fingerprint carries a table row of distances to many random references; within
  a cell, pairs whose largest coordinate difference exceeds `radius` go, and the survivors'
  exact distance is verified.

Equal fingerprints are merged first. A cell emits a spanning set of its links only: the members
already reached from a fingerprint are not compared with one another again. A cell over TILE
fingerprints is laid out by the distance to the first pivot and cut into tiles; each pair of tiles that
hold distances within the radius is a task of its own, the others are skipped.

For a similarity in place of a radius (similar_documents), fingerprints have 256 bits and cells are bands of sampled bits;
discarding and verifying go as above, at a radius two deviations beyond the mean at that similarity. An exact check of
the shingle sets follows: first of the cells' spanning links, then, in the groups which those leave in parts, of every pair
of different parts within the radius. Only texts with such a partner give their sets, once each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, bounded_batches, dropped, free_name, text_bytes, written
from .components import connected_components

WIDTH, RADIUS, PIVOTS = 4, 4, 24
#: Bits of the fingerprints that tell a similarity.
WIDE = 256
#: Fingerprints of one cell that a task compares at most with as many others.
TILE = 4096
#: Expected fingerprints in a cell, above which one more block is used.
CELL = 64


def shingles(text: bytes, width: int) -> list[bytes]:
    """Space-joined runs of width words of a UTF-8 text, repeats included; fewer words make one, no word makes none.

    A-Z is lower-cased and words are cut at ASCII white space.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    if n <= width:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - width])).tolist()
    return list(map(joined.__getitem__, map(slice, starts, (ends[width - 1 :] - 1).tolist())))


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """Bytes (little-endian bits) that are set where over half of the rows of bytes have the bit set."""
    ones = np.zeros(8 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 32768):
        ones += np.add.reduce(np.unpackbits(hashes[at : at + 32768], axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(hashes), bitorder="little")


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """64-bit SimHash of the width-word shingles (repeats count) of a UTF-8 text; no word gives 0.

    A bit is set if it is set in over half of the shingles' XXH64 (seed 42).
    """
    cut = shingles(text, width)
    if not cut:
        return 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(42)), np.uint64, len(cut))
    return int(majority_bits(hashes.view(np.uint8).reshape(-1, 8)).view(np.uint64)[0])


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles, in order."""
    cut = shingles(text, width)
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(42)), np.uint64, len(cut))


def wide_fingerprint(lane: np.ndarray) -> bytes:
    """256-bit SimHash of shingle hashes: they are the first lane, the others are mixed from it by odd multipliers."""
    if not len(lane):
        return bytes(WIDE // 8)
    lanes = [lane]
    for k in range(1, WIDE // 64):
        x = lane + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        lanes.append(x ^ (x >> np.uint64(31)))
    return majority_bits(np.stack(lanes, 1).view(np.uint8)).tobytes()


def radius_of(similarity: float, deviations: float = 2.0) -> int:
    """Differing bits of 256 that shingle sets of that Jaccard similarity have on average, and so many deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(WIDE * p + deviations * math.sqrt(WIDE * p * (1 - p)))


def alike(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets (sorted hashes) have that Jaccard similarity with one, exactly; an empty set has with none."""
    out = np.zeros(len(others), bool)
    size = np.fromiter(map(len, others), np.int64, len(others))
    near = np.flatnonzero((size > 0) & (np.minimum(size, len(one)) / np.maximum(np.maximum(size, len(one)), 1) >= similarity))
    if len(one) and len(near):
        joined = np.concatenate([others[k] for k in near.tolist()])
        at = np.minimum(np.searchsorted(one, joined), len(one) - 1)
        shared = np.add.reduceat((one[at] == joined).astype(np.int64), np.concatenate(([0], np.cumsum(size[near])[:-1])))
        out[near] = shared / (len(one) + size[near] - shared) >= similarity
    return out


def pivots(number: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers, so each task has the same ones."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), 42) for i in range(number)], np.uint64)


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp): th is the text's hash, fp the fingerprint as a signed long. Null text counts as empty."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("fp", T.LongType())])
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.col(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        found = np.fromiter((fingerprint(x, width) for x in text_bytes(batch.column(2))), np.uint64, batch.num_rows)
        return {"id": batch.column(0), "th": batch.column(1), "fp": pa.array(found.view(np.int64))}

    return arrow_pass(named, ["id", "th", "text"], schema, work)


def block_masks(distinct: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the keys that meet every pair within radius, for so many distinct fingerprints."""
    blocks = radius + 1
    while True:
        cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
        parts = [((1 << (y - x)) - 1) << x for x, y in zip(cuts, cuts[1:], strict=False)]
        keys = [sum(c) for c in combinations(parts, blocks - radius)]
        if blocks >= radius + 4 or distinct / 2 ** min(k.bit_count() for k in keys) <= CELL:
            return keys
        blocks += 1


def _keyed(prints: DataFrame, masks: list[int], number: int) -> DataFrame:
    """(t, key, fp, near): a row for each key of each fingerprint with its row of the pivot table."""
    reference, mask = pivots(number), np.array(masks, np.uint64)
    schema = T.StructType([T.StructField("t", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("near", T.BinaryType())])

    def work(batch: pa.RecordBatch) -> dict:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        near = np.bitwise_count(fp[:, None] ^ reference).astype(np.uint8)
        rows = np.repeat(np.arange(len(fp)), len(mask))
        key = (fp[:, None] & mask).ravel()
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(number), len(rows), [None, pa.py_buffer(np.ascontiguousarray(near[rows]))])
        return {"t": np.tile(np.arange(len(mask), dtype=np.int32), len(fp)), "key": pa.array(key.view(np.int64)), "fp": pa.array(fp[rows].view(np.int64)), "near": packed}

    return arrow_pass(prints, ["fp"], schema, work)


def cell_links(fp: np.ndarray, near: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within radius that connect every linked group of a cell (positions in fp)."""
    n, found = len(fp), []
    if n <= 96:
        i, j = np.nonzero(np.triu(np.abs(near[:, None, 0].astype(np.int16) - near[None, :, 0]) <= radius, 1))
        for k in range(1, near.shape[1]):
            if not len(i):
                return found
            keep = np.abs(near[i, k].astype(np.int16) - near[j, k]) <= radius
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        parent = list(range(n))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                found.append((x, y))
        return found
    near = near.astype(np.int16)
    left = np.argsort(near[:, 0], kind="stable")
    first = near[left, 0]
    while len(left):
        stack, left, first = [int(left[0])], left[1:], first[1:]
        while stack and len(left):
            at = stack.pop()
            lo, hi = np.searchsorted(first, [near[at, 0] - radius, near[at, 0] + radius + 1])
            spots = np.arange(lo, hi)
            for k in range(1, near.shape[1]):
                if not len(spots):
                    break
                spots = spots[np.abs(near[left[spots], k] - near[at, k]) <= radius]
            spots = spots[np.bitwise_count(fp[left[spots]] ^ fp[at]) <= radius]
            if len(spots):
                met = left[spots].tolist()
                found += [(at, x) for x in met]
                stack += met
                stay = np.ones(len(left), bool)
                stay[spots] = False
                left, first = left[stay], first[stay]
    return found


def wide_cell_links(fp: np.ndarray, near: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """As cell_links, for 256-bit fingerprints that follow their row of the pivot table in near."""
    bits = np.ascontiguousarray(near[:, -WIDE // 8 :]).view(np.uint64)
    rows = near[:, : -WIDE // 8].astype(np.int16)
    left, found = np.arange(len(fp)), []
    if len(fp) <= 64:  # most cells hold no link
        i, j = np.nonzero(np.triu(np.bitwise_count(bits[:, None] ^ bits[None]).sum(2, dtype=np.int16) <= radius, 1))
        if not len(i):
            return found
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            at = stack.pop()
            spots = np.flatnonzero(np.abs(rows[left] - rows[at]).max(1) <= radius)
            spots = spots[np.bitwise_count(bits[left[spots]] ^ bits[at]).sum(1, dtype=np.int16) <= radius]
            if len(spots):
                met = left[spots].tolist()
                found += [(at, x) for x in met]
                stack += met
                left = np.delete(left, spots)
    return found


def _linked(cells: DataFrame, by: list[str], number: int, radius: int, links_of: Callable = cell_links) -> DataFrame:
    """(a, b) links of all cells; rows of a cell are met in one sorted partition."""
    bounded = cells.select(*by, "fp", "near").repartition(*by).sortWithinPartitions(*by)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    width = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def cut(keys: np.ndarray, fp: np.ndarray, near: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            bounds = [0, *edges.tolist(), len(keys)]
            upto = len(bounds) - (1 if last else 2)
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for x, y in zip(bounds[:upto], bounds[1 : upto + 1], strict=True):
                if y - x > 1 and (links := links_of(fp[x:y], near[x:y], radius)):
                    pairs = np.array(links) + x
                    a.append(fp[pairs[:, 0]])
                    b.append(fp[pairs[:, 1]])
            if not last:
                at = bounds[-2]
                held[:] = [(keys[at:], fp[at:], near[at:])]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(width)], 1)
            fp = batch.column(width).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            near = np.frombuffer(b"".join(batch.column(width + 1).to_pylist()), np.uint8).reshape(-1, number)
            held.append((keys, fp, near))
            if (keys[0] != keys[-1]).any() or (held[0][0][0] != keys[-1]).any():
                joined = [np.concatenate(x) for x in zip(*held, strict=True)]
                held.clear()
                yield from cut(*joined, last=False)
        if held:
            joined = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield from cut(*joined, last=True)

    return bounded.mapInArrow(run, "a long, b long")


def _met(keyed: DataFrame, number: int, radius: int, tile: int, links_of: Callable = cell_links) -> DataFrame:
    """(a, b) links of the cells (t, key); a cell over tile rows is cut into tiles, met pair by pair."""
    sizes = keyed.groupBy("t", "key").count().where(F.col("count") > tile)
    hot = written(sizes.select("t", "key"), "hot-cells")
    if hot.isEmpty():
        return _linked(keyed, ["t", "key"], number, radius, links_of)
    cold = _linked(keyed.join(hot, ["t", "key"], "left_anti"), ["t", "key"], number, radius, links_of)
    return cold.unionByName(_linked(tile_pairs(keyed.join(hot, ["t", "key"]), radius, tile), ["t", "key", "i", "j"], number, radius, links_of))


def tile_pairs(hot: DataFrame, radius: int, tile: int) -> DataFrame:
    """(t, key, i, j, fp, near): rows of cells, once for each pair of tiles in which one within radius may wait for them.

    A cell is laid out by the distance to the first pivot and cut into tiles of about tile rows. A row meets only the tiles that
    hold distances within radius of its own: pairs of tiles further apart are skipped unseen. Rows of one distance are dealt by hash.
    """
    placed = hot.withColumn("c", F.conv(F.hex(F.substring("near", 1, 1)), 16, 10).cast("int"))
    counts = placed.groupBy("t", "key", "c").agg(F.count("*").alias("n"))  # a distance a row: at most 256 a cell
    along = Window.partitionBy("t", "key").orderBy("c")
    laid = counts.withColumn("upto", F.sum("n").over(along))
    reach = along.rangeBetween(-radius, radius)
    laid = laid.select("t", "key", "c", "n", (F.col("upto") - F.col("n")).alias("ahead"), F.min(F.col("upto") - F.col("n")).over(reach).alias("lo"), F.max("upto").over(reach).alias("hi"))
    own = F.expr(f"(ahead + pmod(xxhash64(fp), n)) div {tile}").cast("int")
    other = F.explode(F.expr(f"sequence(cast(lo div {tile} as int), cast((hi - 1) div {tile} as int))"))
    return placed.join(laid, ["t", "key", "c"]).withColumn("own", own).withColumn("other", other).select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "near")


def near_links(prints: DataFrame, radius: int = RADIUS, number: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all within radius of one another."""
    bounded_batches(prints.sparkSession)
    masks = block_masks(prints.count(), radius)
    return _met(_keyed(prints, masks, number), number, radius, tile)


def bands(distinct: int, similarity: float) -> np.ndarray:
    """Masks (bands, 4 lanes) of sampled bits: so many bits that a cell holds some 32 of the fingerprints, and so many
    bands that texts of that similarity share a cell in 97 of 100 cases, likelier the more alike they are."""
    k = min(48, max(12, math.ceil(math.log2(max(distinct, 1) / 32))))
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    out = np.zeros((math.ceil(3.5 / agree**k), WIDE), np.uint8)
    for t, row in enumerate(out):
        row[np.random.default_rng([42, t]).choice(WIDE, k, replace=False)] = 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def similar_links(prints: DataFrame, similarity: float, number: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """(a, b): links between wide fingerprints (fp their hash, bits) within radius_of(similarity), found through bands."""
    bounded_batches(prints.sparkSession)
    masks = bands(prints.count(), similarity)
    reference = np.frombuffer(b"".join(wide_fingerprint(shingle_hashes(f"pivot {i}".encode(), 1)) for i in range(number)), np.uint64).reshape(number, -1)
    schema = T.StructType([T.StructField("t", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("near", T.BinaryType())])
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

    def work(batch: pa.RecordBatch) -> dict:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(len(fp), -1)
        near = np.minimum(np.bitwise_count(bits[:, None] ^ reference).sum(2), 255).astype(np.uint8)
        wide = np.concatenate([near, bits.view(np.uint8).reshape(len(fp), -1)], 1)
        key = np.bitwise_xor.reduce((bits[:, None] & masks) * odd, axis=2)
        rows = np.repeat(np.arange(len(fp)), len(masks))
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(wide[rows]))])
        return {"t": np.tile(np.arange(len(masks), dtype=np.int32), len(fp)), "key": pa.array(key.ravel().view(np.int64)), "fp": pa.array(fp[rows]), "near": packed}

    return _met(arrow_pass(prints, ["fp", "bits"], schema, work), number + WIDE // 8, radius_of(similarity), tile, wide_cell_links)


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp, root): groups of documents linked by width-word shingle sets of that Jaccard similarity or more.

    fp is the hash of the text's shingle set. Candidates come from 256-bit SimHash (similar_links), which meets 97 of 100 pairs of
    just that similarity in a cell and leaves 2 of 100 beyond its radius, fewer of more alike ones; each link is then exact.
    Null text counts as empty; empty texts are one group, linked to no other; repeated rows come back repeated.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bits", T.BinaryType())])
    th = F.xxhash64(F.coalesce(text_col, F.lit("")))
    named = docs.select(F.col(id_col).alias("id"), th.alias("th"), F.col(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        node, bits = [], []
        for x in text_bytes(batch.column(2)):
            lane = shingle_hashes(x, width)
            node.append(xxhash.xxh64_intdigest(np.unique(lane).tobytes()))
            bits.append(wide_fingerprint(lane))
        return {"id": batch.column(0), "th": batch.column(1), "fp": np.array(node, np.uint64).view(np.int64), "bits": pa.array(bits, pa.binary())}

    found = written(arrow_pass(named, ["id", "th", "text"], schema, work), "wide-fingerprints")
    prints = written(found.select("fp", "bits").distinct(), "wide-prints")
    near = similar_links(prints, similarity, tile=tile).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = written(near.distinct(), "near")
    wide = written(connected_components(near), "near-groups")
    sets = _shingle_sets(named, found, wide, width)
    parts = written(connected_components(_checked(near, sets, similarity)), "parts")
    parts = _joined(parts, written(_between_parts(sets, wide, parts, similarity, tile), "between"))
    return found.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("id", "th", "fp", F.coalesce("root", "fp").alias("root"))


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): parts (node, root) that links (a, b) join, texts that have no part too; only the roots of parts are linked anew."""
    if links.isEmpty():
        return parts
    a, b = (parts.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    over = written(connected_components(links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))), "joined-parts")
    moved = parts.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(over.join(parts, "node", "left_anti"))


def _shingle_sets(named: DataFrame, found: DataFrame, wide: DataFrame, width: int) -> DataFrame:
    """(fp, bits, hashes) of each fp that has a near one, from one of its texts; only those texts are shuffled."""
    key = [F.coalesce(F.col("id").cast("string"), F.lit("")).alias("_id"), "th"]
    chosen = found.join(wide.select(F.col("node").alias("fp")), "fp", "left_semi").groupBy("fp").agg(F.min(F.struct(*key)).alias("w"))
    texts = named.select(*key, "text").join(chosen.select("fp", "w.*"), ["_id", "th"]).dropDuplicates(["fp"])
    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("hashes", T.BinaryType())])

    def work(batch: pa.RecordBatch) -> dict:
        lanes = [shingle_hashes(x, width) for x in text_bytes(batch.column(1))]
        return {"fp": batch.column(0), "bits": pa.array(map(wide_fingerprint, lanes), pa.binary()), "hashes": pa.array((np.unique(x).tobytes() for x in lanes), pa.binary())}

    return written(arrow_pass(texts, ["fp", "text"], schema, work), "shingle-sets")


def _checked(near: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the links (a, b) whose shingle sets are alike; a much linked set is split by adaptive execution."""
    one, other = (sets.select(F.col("fp").alias(x), F.col("hashes").alias(f"set_{x}")) for x in "ab")
    both = near.join(one, "a").join(other, "b")

    def work(batch: pa.RecordBatch) -> dict | None:
        pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        keep = pa.array([bool(alike(np.frombuffer(x, np.uint64), [np.frombuffer(y, np.uint64)], similarity)[0]) for x, y in pairs])
        return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return written(arrow_pass(both, ["a", "b", "set_a", "set_b"], schema, work), "checked")


def part_links(part: np.ndarray, bits: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links between different parts (positions): each text outside the largest part meets all of the others within radius."""
    names, part = np.unique(part, return_inverse=True)
    part, found = part.copy(), []
    for x in np.flatnonzero(part != np.bincount(part, minlength=len(names)).argmax()).tolist():
        spots = np.flatnonzero(part != part[x])
        spots = spots[np.bitwise_count(bits[spots] ^ bits[x]).sum(1, dtype=np.int16) <= radius]
        for y in spots[alike(sets[x], [sets[k] for k in spots.tolist()], similarity)].tolist():
            if part[y] != part[x]:
                found.append((x, y))
                part[part == part[x]] = part[y]
    return found


def _between_parts(sets: DataFrame, wide: DataFrame, parts: DataFrame, similarity: float, tile: int, tile_bytes: int = 32 << 20) -> DataFrame:
    """(a, b): links between the parts into which checking split the groups of near texts.

    In each group every text outside the largest part meets all texts of other parts. Such texts, and those of the largest part, are
    cut into tiles by number and bytes, and each pair of tiles, but for two of the largest part, is a task.
    """
    size = F.octet_length("hashes").cast("long")
    rows = sets.join(wide.select(F.col("node").alias("fp"), F.col("root").alias("g")), "fp").join(parts.select(F.col("node").alias("fp"), F.col("root").alias("part")), "fp", "left")
    rows = rows.select("g", "fp", F.coalesce("part", "fp").alias("part"), "bits", "hashes", size.alias("size"))
    by = rows.groupBy("g", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    big = F.max_by("part", F.struct("n", "part"))
    split = by.groupBy("g").agg(big.alias("big"), F.max("n").alias("n"), F.max_by("size", F.struct("n", "part")).alias("size"), F.sum("n").alias("all_n"), F.sum("size").alias("all_size"), F.count("*").alias("parts"))

    def tiles(n: str, b: str) -> object:
        return F.greatest(F.expr(f"ceil(({n}) / {tile})"), F.expr(f"ceil(({b}) / {tile_bytes})"), F.lit(1)).cast("int")

    split = written(split.where("parts > 1").select("g", "big", tiles("all_n - n", "all_size - size").alias("rest_tiles"), tiles("n", "size").alias("big_tiles")), "split-groups")
    rows = rows.drop("size").join(split, "g").withColumn("outside", F.expr("part <> big"))
    own = F.when(F.col("outside"), F.expr("pmod(xxhash64(fp), rest_tiles)")).otherwise(F.expr("rest_tiles + pmod(xxhash64(fp), big_tiles)")).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.when(F.col("outside"), F.expr("rest_tiles + big_tiles - 1")).otherwise(F.expr("rest_tiles - 1"))))
    paired = rows.withColumn("own", own).withColumn("other", met).select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "part", "bits", "hashes")
    schema, radius = pa.schema([("a", pa.int64()), ("b", pa.int64())]), radius_of(similarity)

    def run(table: pa.Table) -> pa.Table:
        fp, part = (table.column(x).to_numpy() for x in ("fp", "part"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(fp), -1)
        found = part_links(part, bits, [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()], radius, similarity)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(fp[at[:, 0]]), pa.array(fp[at[:, 1]])], schema=schema)

    return paired.groupBy("g", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, number: int = PIVOTS, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, th, fp, root, component_id): one row a document with its group and the smallest id in it.

    Null text counts as empty (fingerprint 0, linked like any other); a null id is never the smallest
    unless its whole group has none, then component_id is null; repeated rows come back repeated.
    """
    found = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    prints = found.select("fp").distinct()
    prints = written(prints, "prints")
    links = near_links(prints, radius, number, tile)
    parts = connected_components(links)
    least = found.groupBy("fp").agg(F.min("id").alias("first"))
    rooted = least.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(lowest, "root").select("fp", "root", "component_id")
    dropped(prints)
    return found.join(of_print, "fp").select("id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group: the smallest id (null last), then the smallest text hash.

    groups (id, th, root) are those of near_duplicates unless given. Texts are shuffled once.
    """
    if groups is None:
        groups = near_duplicates(docs, id_col=id_col, text_col=text_col)
    n, i, h = (free_name(docs, f"_{x}") for x in ("null", "id", "th"))
    least = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("w"))
    # keys without nulls, so that the join's partitions also serve the last step
    winners = least.select(F.col("w.none").alias(n), F.coalesce(F.col("w.id").cast("string"), F.lit("")).alias(i), F.col("w.th").alias(h))
    named = docs.select("*", F.col(id_col).isNull().alias(n), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(i), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias(h))
    return named.join(winners, [n, i, h], "left_semi").dropDuplicates([n, i, h]).select(*docs.columns)
