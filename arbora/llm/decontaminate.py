"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are gapped 2-grams, two words at most one apart, in the item as in the document. Let G be the score that
makes a leak of an item. Between two matched words that follow each other in an alignment, each error costs 1,
so of M matches, at most M - G / 2 neighbours have two errors or more between them, and G / 2 - 1 or
more have one at most: so many of the item's words begin a gapped 2-gram that the document holds too, within
the 3 * words - G words that such an alignment can span. No edit that leaves the score at G goes unseen.

Documents are read twice. The first pass counts in how many documents each 2-gram occurs, and the most frequent
half of the beginnings that must hit are left out as seeds; the others must still hit half as often. The second
pass looks the seeds up in each document; passages with hits enough are aligned with the item word by word
(match 2, mismatch -1, gap -1). A passage whose score reaches min_score of the item's best possible
score, with its words edited, dropped or added, is a leak.

Seeds and items meet documents as in a broadcast join: test items are handled in blocks of at most ITEMS items
and ITEM_BYTES bytes, each with two passes over the documents, so what a task holds is bounded however long the
list; hits of one passage are merged before alignment. Items of fewer than MIN_WORDS words are looked for as they
are, all their words in a row; a shorter part of them says nothing. Scripts without spaces count
by character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, free_name, text_bytes, whole_number, with_columns_pass

#: Distances between the two words of a gapped 2-gram.
STEPS = (1, 2)
#: Share of an item's best alignment score that makes a leak, and words under which an item must be there whole.
MIN_SCORE, MIN_WORDS = 0.5, 8
ITEMS, ITEM_BYTES = 20_000, 4 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Thai, Lao, Burmese, Khmer, kana, Han.
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_MARKS = b".,;:!?\"'()[]{}*#$%&|<>"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words, cut at ASCII white space, without marks; a word of marks alone is none."""
    if text.isascii():
        lower = text.lower()
    else:
        said = text.decode("utf-8", "replace").lower()
        lower = (_SPACELESS.sub(r" \g<0> ", said) if _SPACELESS.search(said) else said).encode()
    return lower.translate(None, _MARKS).split()


def codes_of(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words among the items' words, 0 for others."""
    words = words_of(text)
    return np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))


@dataclass
class Items:
    """A block of test items: word numbers, and a sorted table of their n-grams; ids has the short items last."""

    ids: list[int]
    words: list[np.ndarray]
    short: list[np.ndarray]
    known: dict[bytes, int]
    grams: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]], min_words: int = MIN_WORDS) -> Items:
        known: dict[bytes, int] = {}
        words, short = [], []
        for item, text in rows:
            if found := words_of(text):
                part = words if len(found) >= min_words else short
                part.append((item, np.array([known.setdefault(w, len(known) + 1) for w in found], np.int64)))
        ids = [i for i, _ in words + short]
        words, short = [w for _, w in words], [w for _, w in short]
        every = [grams(w)[0] for w in words]
        return cls(ids, words, short, known, np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64))


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, first words' positions) of the gapped 2-grams of known words."""
    value, spots = [], []
    for step in STEPS:
        spot = np.flatnonzero((codes[:-step] > 0) & (codes[step:] > 0))
        spots.append(spot)
        value.append((codes[spot].astype(np.uint64) << np.uint64(32)) | codes[spot + step].astype(np.uint64))
    return np.concatenate(value), np.concatenate(spots)


def gram_hits(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, table rows) of a document's gapped 2-grams that are in the sorted table."""
    value, spots = grams(codes)
    if not len(value) or not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(table, value)
    row[row == len(table)] = 0
    keep = table[row] == value
    return spots[keep], row[keep]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(best Smith-Waterman score, first and last word + 1 of the passage's part)."""
    m = len(passage)
    before, start_before = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, at = 0, (0, 0)
    ramp = np.arange(m + 1)
    for w in item:
        diagonal = before[:-1] + np.where(passage == w, MATCH, MISMATCH)
        down = before[1:] + GAP
        take = diagonal >= down
        cell = np.where(take, diagonal, down)
        origin = np.where(take, start_before[:-1], start_before[1:])
        empty = cell <= 0
        cell = np.where(empty, 0, cell)
        origin = np.where(empty, ramp[1:], origin)
        # gaps along the passage: best of cell[j - k] + k * GAP
        lifted = np.concatenate(([0], cell)) - GAP * ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, ramp, 0))
        now = top + GAP * ramp
        begun = np.concatenate(([0], origin))[source]
        dead = now <= 0
        before = np.where(dead, 0, now)
        start_before = np.where(dead, ramp, begun)
        k = int(before.argmax())
        if before[k] > best:
            best, at = int(before[k]), (int(start_before[k]), k)
    return best, *at


def document_frequencies(docs: DataFrame, items: Items, text_col: str = "text") -> np.ndarray:
    """Documents that hold each n-gram of the items; counts meet as sums, a row an n-gram and partition."""
    table = items.grams
    named = docs.select(F.col(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> dict | None:
        count = np.zeros(len(table), np.int64)
        for text in text_bytes(batch.column(0)):
            _, row = gram_hits(codes_of(text, items.known), table)
            count[np.unique(row)] += 1
        seen = np.flatnonzero(count)
        return {"g": seen, "n": count[seen]}

    schema = T.StructType([T.StructField("g", T.LongType()), T.StructField("n", T.LongType())])
    out = np.zeros(len(table), np.int64)
    found = arrow_pass(named, ["text"], schema, work).groupBy("g").agg(F.sum("n").alias("n")).toArrow()  # at most a row an n-gram of the block
    out[found["g"].to_numpy()] = found["n"].to_numpy()
    return out


class Seeds:
    """Seeds of a block of items: the 2-grams of all but the most frequent beginnings."""

    def __init__(self, items: Items, frequency: np.ndarray, min_score: float = MIN_SCORE) -> None:
        sizes = np.array([len(w) for w in items.words], np.int64)
        self.goal = np.ceil(min_score * MATCH * sizes - 1e-9).astype(np.int64)
        #: Words that an alignment of the goal can span.
        self.span = 3 * sizes - self.goal
        must = np.maximum(1, -(-self.goal // 2) - 1)
        #: Seeds that hit in each such alignment.
        self.least = must - must // 2
        pairs = []
        for k, words in enumerate(items.words):
            value, spot = grams(words)
            row = np.searchsorted(items.grams, value)
            often = np.bincount(spot, frequency[row], len(words))
            kept = np.ones(len(words), bool)
            kept[np.argsort(-often, kind="stable")[: must[k] // 2]] = False
            row = row[kept[spot] & (frequency[row] > 0)]
            pairs.append(np.stack([row, np.full(len(row), k)], 1))
        made = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        rows, begins = np.unique(made[:, 0], return_index=True)
        self.table = items.grams[rows]
        self.bounds = np.append(begins, len(made))
        self.item = np.ascontiguousarray(made[:, 1])
        self.items = items
        #: Short items by their first word.
        self.begun: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.leads = np.zeros(len(items.known) + 1, bool)
        for k, words in enumerate(items.short, len(items.words)):
            self.begun.setdefault(int(words[0]), []).append((k, words))
            self.leads[words[0]] = True

    def whole(self, words: np.ndarray) -> dict[int, int]:
        """The first place of each short item that is there whole."""
        out: dict[int, int] = {}
        for at in np.flatnonzero(self.leads[words]).tolist() if self.begun else []:
            for k, goal in self.begun[int(words[at])]:
                if k not in out and len(words) >= at + len(goal) and (words[at : at + len(goal)] == goal).all():
                    out[k] = at
        return out

    def passages(self, words: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Ranges of a document's words, by item, outside which no alignment of the goal lies."""
        spots, row = gram_hits(words, self.table)
        if not len(spots):
            return {}
        begin = self.bounds[row]
        many = self.bounds[row + 1] - begin
        ends = np.cumsum(many)
        item = self.item[np.repeat(begin - ends + many, many) + np.arange(ends[-1])]
        key = np.unique((item << 32) | np.repeat(spots, many))
        item, spot = key >> 32, key & 0xFFFFFFFF
        last = np.arange(len(key)) + self.least[item] - 1
        inside = last < len(key)
        last = np.where(inside, last, 0)
        met = np.flatnonzero(inside & (item[last] == item) & (spot[last] - spot < self.span[item]))
        out: dict[int, list[tuple[int, int]]] = {}
        for k, at in zip(item[met].tolist(), spot[met].tolist(), strict=True):
            reach = int(self.span[k])
            a, b = max(0, at - reach), min(len(words), at + reach + 1)
            held = out.setdefault(k, [])
            if held and a <= held[-1][1]:
                held[-1] = (held[-1][0], b)
            else:
                held.append((a, b))
        return out

    def leaks(self, text: bytes) -> list[tuple[int, float, int, int]]:
        """(item number, score, first word, last word + 1) of the best passage of each item that leaks."""
        words = codes_of(text, self.items.known)
        out = []
        for item, ranges in self.passages(words).items():
            goal = self.items.words[item]
            size, most = len(goal), MATCH * len(goal)
            best = (0, 0, 0)
            for a, b in ranges:
                part = words[a:b]
                # no alignment scores over the words they share
                shared = int(np.isin(part, goal).sum())
                if MATCH * min(shared, size) >= self.goal[item] and MATCH * min(shared, size) > best[0]:
                    score, x, y = align(goal, part)
                    if score > best[0]:
                        best = (score, a + x, a + y)
            if best[0] >= self.goal[item]:
                out.append((item, best[0] / most, best[1], best[2]))
        out += [(k, 1.0, at, at + len(self.items.short[k - len(self.items.words)])) for k, at in self.whole(words).items()]
        return sorted(out)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = ITEMS) -> Iterator[Items]:
    """The test items in blocks of at most size and ITEM_BYTES, one on the driver at a time.

    Rows without id or text are left out; an item id that is no whole number is an error.
    """
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(whole_number(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    held: list[tuple[int, bytes]] = []
    for r in rows.toLocalIterator():
        item = (r["i"], r["t"].encode())
        if held and (len(held) == size or sum(len(t) for _, t in held) + len(item[1]) > ITEM_BYTES):
            yield Items.of(sorted(held))
            held = []
        held.append(item)
    if held:
        yield Items.of(sorted(held))


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, score, first_word, last_word): the best passage of each item that leaks into a document.

    Words count from 0, last_word is the last one's number. Null and empty texts have no leak; repeated rows
    each have theirs; items under MIN_WORDS words are found whole only; no items give no rows. A clashing column
    of docs does no harm, as only the id and the text are read.
    """
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType())]
    )
    out = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark):
        seeds = Seeds(items, document_frequencies(docs, items, text_col), min_score)

        def work(batch: pa.RecordBatch, seeds: Seeds = seeds) -> dict:
            rows: list[int] = []
            found: list[tuple] = []
            for row, text in enumerate(text_bytes(batch.column(1))):
                for leak in seeds.leaks(text):
                    rows.append(row)
                    found.append(leak)
            return {
                id_col: batch.column(0).take(pa.array(rows, pa.int64())), "item_id": pa.array([seeds.items.ids[f[0]] for f in found], pa.int64()), "score": pa.array([f[1] for f in found], pa.float64()),
                "first_word": pa.array([f[2] for f in found], pa.int32()), "last_word": pa.array([f[3] - 1 for f in found], pa.int32()),
            }

        out = out.unionByName(arrow_pass(docs, [id_col, text_col], schema, work))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """docs without the rows into which a test item leaks; columns and other rows stay as they are."""
    name = free_name(docs, "_leaks")
    out = docs
    for items in item_blocks(benchmark):
        # counted over the given documents, so no block's pass runs an earlier one again
        seeds = Seeds(items, document_frequencies(docs, items, text_col), min_score)

        def work(texts: list[bytes], seeds: Seeds = seeds) -> dict:
            return {name: [bool(seeds.leaks(x)) for x in texts]}

        out = with_columns_pass(out, text_col, T.StructType([T.StructField(name, T.BooleanType())]), work).where(~F.col(name)).drop(name)
    return out
