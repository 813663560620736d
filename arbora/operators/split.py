"""Samples and splits: hash samples are declarative, the greedy stratifier is one sequential task over numbers."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pair_hash


def hash_sample(records: DataFrame, n: int, key: str = "pair_id") -> DataFrame:
    """Records whose key is among the n smallest hashes; a blank key is an error."""
    bad = records.where(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).limit(1).count()
    if bad:
        raise ValueError(f"a record has no {key}")
    keys = records.select(key).distinct().orderBy(pair_hash(key), key).limit(n)
    return records.join(keys, key, "left_semi")


def first_n(records: DataFrame, n: int, order: str = "ord") -> DataFrame:
    return records.orderBy(order).limit(n)


def seeded_sample(records: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """n ids drawn with a seed, in the order of a hash of seed and id: the same for any partitioning."""
    picked = records.select(key).distinct().orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(n)
    return records.join(picked, key, "left_semi")


def review_sample(records: DataFrame, n: int, bucket: str = "domain", order: str = "ord") -> DataFrame:
    """n records with `pick`, 1 up: max(1, n div buckets) first ones of each bucket by bucket name, topped up from the head."""
    buckets = records.agg(F.count_distinct(F.coalesce(bucket, F.lit("other"))).alias("_b"))
    named = records.withColumn("_d", F.coalesce(bucket, F.lit("other"))).crossJoin(F.broadcast(buckets))
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest(F.lit(1), "_b")))
    ranked = named.withColumn("_k", F.row_number().over(Window.partitionBy("_d").orderBy(order)))
    first = F.col("_k") <= quota
    keyed = ranked.withColumns({"_p": F.when(first, 0).otherwise(1), "_q": F.when(first, F.col("_d"))})
    chosen = keyed.orderBy("_p", "_q", order).limit(n)
    return chosen.withColumn("pick", F.row_number().over(Window.orderBy("_p", "_q", order))).drop("_d", "_b", "_k", "_p", "_q")


def capacities(total: int, ratios: Sequence[float]) -> list[int]:
    """Whole sizes by largest remainder, ties to the earlier split."""
    if any(r < 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios are not negative and sum to 1")
    shares = [total * r for r in ratios]
    floors = [int(s) for s in shares]
    spare = sorted(range(len(ratios)), key=lambda i: (floors[i] - shares[i], i))[: total - sum(floors)]
    return [f + (i in spare) for i, f in enumerate(floors)]


def shuffled_split(records: DataFrame, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42, key: str = "id") -> DataFrame:
    """Adds split 0, 1, ..: exact sizes in the order of a hash of seed and id, cut by range partitions and not by one task."""
    from .hierarchy import row_order

    hashed = records.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256))
    ends = capacities(records.count(), ratios)
    upto, split = 0, F.lit(len(ratios) - 1)
    cuts = []
    for i, size in enumerate(ends[:-1]):
        upto += size
        cuts.append((upto, i))
    for end, i in reversed(cuts):
        split = F.when(F.col("ord") < end, F.lit(i)).otherwise(split)
    return row_order(hashed, "_h", key).withColumn("split", split).drop("_h", "ord")


class _Stratifier:
    """Places groups one by one where their labels are needed most, then where most room is left, then first; labels are numbers."""

    def __init__(self, label_counts: Sequence[int], room: list[int], ratios: Sequence[float]) -> None:
        self.capacity, self.room = room, list(room)
        self.every = [s for s, c in enumerate(room) if c > 0] or [0]
        self.target = [[n * r for n in label_counts] for r in ratios]
        self.scale = [[max(v, 0.1) for v in t] for t in self.target]
        self.need = [[v / w for v, w in zip(t, c, strict=True)] for t, c in zip(self.target, self.scale, strict=True)]

    def share(self, s: int) -> float:
        return self.room[s] / self.capacity[s] if self.capacity[s] else 0.0

    def place(self, sizes: Sequence[int], ends: Sequence[int], labels: Sequence[int]) -> list[int]:
        """The splits of groups in their order; a group's labels end in labels where ends tells."""
        room, every, share = self.room, self.every, self.share
        needs = [x.__getitem__ for x in self.need]
        least, lo, out = min(room[s] for s in every), 0, []
        for size, hi in zip(sizes, ends, strict=True):
            own, n = labels[lo:hi], hi - lo
            lo = hi
            able = every if size <= least else [s for s in every if room[s] >= size] or [s for s in every if room[s] > 0] or every
            best, most = -1, 0.0
            for s in able:
                need = sum(map(needs[s], own)) / n if n else 0.0
                if best < 0 or need > most or (need == most and share(s) > share(best)):
                    best, most = s, need
            room[best] -= size
            if room[best] < least:
                least = room[best]
            target, scale, need_of = self.target[best], self.scale[best], self.need[best]
            for k in own:
                target[k] = left = target[k] - size
                need_of[k] = left / scale[k]
            out.append(best)
        return out


def _drawing(seed: int, after: int) -> np.random.RandomState:
    """Gives by random_sample the numbers of random.Random(seed) after the first `after` ones: one generator, its state handed over."""
    _, state, _ = random.Random(seed).getstate()
    made = np.random.RandomState()
    made.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    for lo in range(0, after, 1_000_000):
        made.random_sample(min(1_000_000, after - lo))
    return made


def stratified_split(records: DataFrame, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42, group: str | None = None, key: str = "id", labels: str = "labels", order: str = "ord") -> DataFrame:
    """Adds split 0, 1, 2: iterative multi-label stratification with exact sizes (groups stay whole and may shift them).

    Groups are met by most labels, rarest label, a seeded draw and first appearance. Counting, drawing and both sorts are
    distributed over ranges; the greedy choice is sequential, and its task reads numbers alone: the sizes and labels of a
    batch of groups as a row, in order, as a stream. It holds a batch of them and the counts of labels.
    """
    twice = records.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated id {twice[0][key]}")
    name = group or key
    own = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(labels, F.array().cast(records.schema[labels].dataType)))))
    named = records.select(F.col(name).cast("string").alias("g"), F.col(order).alias("first"), own.alias("labels"))
    if group is None and named.where("g is null").isEmpty():
        table = named.select("g", F.lit(1).cast("long").alias("size"), "first", "labels")
    else:
        table = named.groupBy("g").agg(F.count("*").alias("size"), F.min("first").alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"))
    met = F.asc_nulls_last("first"), F.col("g")
    ranged = table.repartitionByRange(*met).sortWithinPartitions(*met).select("g", "size", "labels", F.spark_partition_id().alias("p")).persist(StorageLevel.MEMORY_AND_DISK)
    parts = ranged.groupBy("p").agg(F.count("*").alias("n"), F.sum("size").alias("size")).orderBy("p").collect()  # a row a range
    ahead = dict(zip([r["p"] for r in parts], np.cumsum([0, *(r["n"] for r in parts)]).tolist()[:-1], strict=True))
    counts = dict(sorted((r["label"], r["n"]) for r in ranged.select(F.explode("labels").alias("label"), "size").groupBy("label").agg(F.sum("size").alias("n")).collect()))  # labels of one tree
    wanted, texts, many = list(ratios), list(counts), list(counts.values())
    room = capacities(sum(r["size"] for r in parts), wanted)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, i, values, n = None, 0, pa.array(texts, pa.string()), np.array([*many, 0], np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            if made is None:
                i = ahead[b.column("p")[0].as_py()]
                made = _drawing(seed, i)
            code = pc.index_in(b.column("labels").flatten(), value_set=values).cast(pa.int32())
            size = b.column("labels").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            rare = np.zeros(b.num_rows, np.int64)
            if len(code):
                rare[size > 0] = np.minimum.reduceat(n[code.to_numpy(zero_copy_only=False)], (np.cumsum(size) - size)[size > 0])
            coded = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), code)
            keys = [pa.array(x) for x in (-size, rare, made.random_sample(b.num_rows), np.arange(i, i + b.num_rows))]
            i += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("size"), coded, *keys], names=["g", "size", "labels", "_few", "_rare", "_draw", "_at"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(x for x in batches if x.num_rows):
            lists = b.column("labels")
            numbers = [b.column("size"), lists.value_lengths(), lists.flatten()]
            whole = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("g"))
            yield pa.RecordBatch.from_arrays([b.column("p").slice(0, 1), pa.array([k], pa.int32()), whole, *(pa.array([x.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for x in numbers)], names=["p", "k", "g", "sizes", "lengths", "codes"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser = _Stratifier(many, room, wanted)
        for b in batches:
            found = []
            for numbers in zip(*(b.column(c).to_pylist() for c in ("sizes", "lengths", "codes")), strict=True):
                size, length, code = (np.frombuffer(x, np.int64) for x in numbers)
                found.append(chooser.place(size.tolist(), np.cumsum(length).tolist(), code.tolist()))
            yield pa.RecordBatch.from_arrays([b.column("p"), b.column("k"), pa.array(found, pa.list_(pa.int32()))], names=["p", "k", "split"])

    keys = ("_few", "_rare", "_draw", "_at")
    drawn = ranged.mapInArrow(draw, "g string, size long, labels array<int>, _few long, _rare long, _draw double, _at long")
    sorted_ = drawn.repartitionByRange(*keys).sortWithinPartitions(*keys).select("g", "size", "labels", F.spark_partition_id().alias("p"))
    packed = sorted_.mapInArrow(pack, "p int, k int, g array<string>, sizes binary, lengths binary, codes binary").persist(StorageLevel.MEMORY_AND_DISK)  # a batch's place in the order is told by p and k
    placed = packed.select("p", "k", "sizes", "lengths", "codes").repartition(1).sortWithinPartitions("p", "k").mapInArrow(place, "p int, k int, split array<int>")
    each = packed.select("p", "k", "g").join(placed, ["p", "k"]).select(F.inline(F.arrays_zip(F.col("g").alias("_arbora_g"), "split")))
    return records.join(each, F.col(name).cast("string").eqNullSafe(F.col("_arbora_g"))).drop("_arbora_g")


def group_folds(records: DataFrame, k: int, group: str) -> DataFrame:
    """Adds fold: whole groups to k folds by a hash, so a fold is known without seeing the others."""
    return records.withColumn("fold", F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(k)).cast("int"))


def fold_group(pair: str = "pair_id", project: str = "project_id", own: str = "id") -> object:
    """The group of a record: its pair, else its project, else itself."""
    return F.coalesce(F.nullif(F.col(pair), F.lit("")), F.nullif(F.col(project), F.lit("")), F.col(own))


def exact_ratios(text: str) -> list[float]:
    """Ratios written as a/b/c."""
    parts = [Fraction(x) for x in text.split("/")]
    return [float(p / sum(parts)) for p in parts]
