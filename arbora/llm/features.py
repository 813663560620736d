"""Hashed word and character n-gram features of whole texts, and logistic models on them.

A text's score is z = mean word weight + mean character weight + structure . v + bias. Weights live
in hashed tables, so a model has one size whatever the corpus, and scoring is a lookup a token.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_pass, sigmoid, starts_of, text_bytes

WORD_BITS, CHAR_BITS, CHAR_N = 16, 16, 3
#: Distinct tokens whose hashes a worker remembers; others are hashed again.
REMEMBERED = 400_000
STRUCTURE = 8


class TokenIds(dict):
    """Raw token -> hashed bucket of the token; bounded."""

    def __missing__(self, token: bytes) -> int:
        at = xxhash.xxh32_intdigest(token.strip(b".,;:!?\"'()")) & ((1 << WORD_BITS) - 1)
        if len(self) < REMEMBERED:
            self[token] = at
        return at


def structure(text: bytes, words: list[bytes], ids: np.ndarray) -> list[float]:
    """Numbers on a text's build, each about 0 to 1: length, variety, repeats, symbols, capitals, marks, bars."""
    n = len(words)
    if not n:
        return [0.0] * STRUCTURE
    size = max(1, len(text))
    counts = np.bincount(ids.astype(np.int64) & 4095, minlength=4096)
    return [
        min(1.0, np.log1p(n) / 10),
        float((counts > 0).sum() / min(n, 4096)),
        float(counts.max() / n),
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        min(1.0, sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">"))) / n),
        min(1.0, 3 * (size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size),
        min(1.0, text.count(b"!") / n),
        min(1.0, text.count(b"|") / n),
    ]


def char_codes(text: bytes) -> np.ndarray:
    """Hashed buckets of all byte n-grams of a text."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    m = len(raw) - CHAR_N + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    code = raw[:m] | (raw[1 : m + 1] << 8) | (raw[2 : m + 2] << 16)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS)


def word_codes(words: list[bytes], ids: TokenIds) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, and of the word pairs next to one another."""
    one = np.fromiter(map(ids.__getitem__, words), np.uint32, len(words))
    two = ((one[:-1] * np.uint32(40503)) ^ (one[1:] * np.uint32(2654435769))) >> np.uint32(32 - WORD_BITS)
    return one, two


@dataclass
class Linear:
    """Weights by bucket: words, word pairs, characters, structure; a bias; calibration a*z + b."""

    one: np.ndarray = field(default_factory=lambda: np.zeros(1 << WORD_BITS, np.float32))
    two: np.ndarray = field(default_factory=lambda: np.zeros(1 << WORD_BITS, np.float32))
    char: np.ndarray = field(default_factory=lambda: np.zeros(1 << CHAR_BITS, np.float32))
    build: np.ndarray = field(default_factory=lambda: np.zeros(STRUCTURE, np.float32))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, text: bytes, words: list[bytes], ids: TokenIds) -> float:
        one, two = word_codes(words, ids)
        z = self.bias + float(np.dot(self.build, structure(text, words, one)))
        if len(one):
            z += float(self.one[one].mean())
        if len(two):
            z += float(self.two[two].mean())
        code = char_codes(text)
        if len(code):
            z += float(self.char[code].mean())
        return z

    def probability(self, z: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * np.asarray(z) + self.shift)


_DENSE = (1 << WORD_BITS) * 2 + (1 << CHAR_BITS) + STRUCTURE


def sparse_row(text: bytes, ids: TokenIds) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a text in the space of Linear's tables laid end to end."""
    words = text.split()
    one, two = word_codes(words, ids)
    columns, values = [], []
    for at, code in ((0, one), (1 << WORD_BITS, two), (2 << WORD_BITS, char_codes(text))):
        if len(code):
            c, n = np.unique(code, return_counts=True)
            columns.append(c.astype(np.int64) + at)
            values.append(n / len(code))
    columns.append(np.arange(_DENSE - STRUCTURE, _DENSE))
    values.append(np.array(structure(text, words, one)))
    return np.concatenate(columns).astype(np.int32), np.concatenate(values).astype(np.float32)


@dataclass
class Rows:
    """A bounded sample of texts as a sparse matrix in row order."""

    columns: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    y: np.ndarray
    ids: np.ndarray

    def __len__(self) -> int:
        return len(self.y)

    def times(self, w: np.ndarray) -> np.ndarray:
        if not len(self):
            return np.zeros(0)
        return np.add.reduceat(self.values * w[self.columns], self.starts[:-1])

    def back(self, g: np.ndarray) -> np.ndarray:
        per = np.repeat(g, np.diff(self.starts))
        return np.bincount(self.columns, self.values * per, minlength=_DENSE)

    def take(self, rows: np.ndarray) -> Rows:
        parts = [slice(self.starts[i], self.starts[i + 1]) for i in rows]
        empty = np.zeros(0)
        return Rows(
            np.concatenate([self.columns[p] for p in parts]) if parts else empty.astype(np.int32),
            np.concatenate([self.values[p] for p in parts]) if parts else empty.astype(np.float32),
            starts_of(np.array([p.stop - p.start for p in parts], np.int64)),
            self.y[rows], self.ids[rows],
        )


def gathered(sample: DataFrame) -> Rows:
    """Features of a bounded sample (_id, _text, _y) on the driver, in id order."""
    schema = T.StructType(
        [T.StructField("id", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("c", T.ArrayType(T.IntegerType())), T.StructField("v", T.ArrayType(T.FloatType()))]
    )
    named = sample.selectExpr("cast(_id as string) as id", "_y as y", "_text as text")

    def work(batch: pa.RecordBatch) -> dict:
        ids = TokenIds()
        made = [sparse_row(x, ids) for x in text_bytes(batch.column(2))]
        at = pa.array(starts_of(np.array([len(c) for c, _ in made])).astype(np.int32))
        return {
            "id": batch.column(0), "y": batch.column(1),
            "c": pa.ListArray.from_arrays(at, pa.array(np.concatenate([c for c, _ in made]))),
            "v": pa.ListArray.from_arrays(at, pa.array(np.concatenate([v for _, v in made]))),
        }

    found = arrow_pass(named, ["id", "y", "text"], schema, work).toArrow().combine_chunks()
    if not found.num_rows:
        none = np.zeros(0, np.int64)
        return Rows(none, np.zeros(0, np.float32), np.zeros(1, np.int64), none, none)
    found = found.sort_by("id")
    c, v = found["c"].combine_chunks(), found["v"].combine_chunks()
    lengths = np.diff(c.offsets.to_numpy())
    return Rows(c.flatten().to_numpy(), v.flatten().to_numpy(), starts_of(lengths), found["y"].to_numpy(), np.array(found["id"].to_pylist()))


def unpacked(w: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0) -> Linear:
    a = 1 << WORD_BITS
    w = w.astype(np.float32)
    return Linear(w[:a], w[a : 2 * a], w[2 * a : 2 * a + (1 << CHAR_BITS)], w[_DENSE - STRUCTURE :], float(bias), float(slope), float(shift))


class Adam:
    """Full-batch Adam on the tables' columns and a bias."""

    def __init__(self, rate: float, l2: float) -> None:
        self.w, self.b, self.rate, self.l2, self.t = np.zeros(_DENSE), 0.0, rate, l2, 0
        self.m, self.s, self.mb, self.sb = np.zeros(_DENSE), np.zeros(_DENSE), 0.0, 0.0

    def step(self, gw: np.ndarray, gb: float) -> None:
        self.t += 1
        gw = gw + self.l2 * self.w
        self.m += 0.1 * (gw - self.m)
        self.s += 0.001 * (gw * gw - self.s)
        self.mb += 0.1 * (gb - self.mb)
        self.sb += 0.001 * (gb * gb - self.sb)
        u, v = 1 - 0.9**self.t, 1 - 0.999**self.t
        self.w -= self.rate * (self.m / u) / (np.sqrt(self.s / v) + 1e-8)
        self.b -= self.rate * (self.mb / u) / (np.sqrt(self.sb / v) + 1e-8)


def fit_logistic(rows: Rows, weights: np.ndarray, steps: int = 120, rate: float = 0.3, l2: float = 1e-6) -> Adam:
    """Weighted logistic regression; y is 0 or 1."""
    model, total = Adam(rate, l2), max(weights.sum(), 1e-9)
    for _ in range(steps):
        g = weights * (sigmoid(rows.times(model.w) + model.b) - rows.y) / total
        model.step(rows.back(g), float(g.sum()))
    return model


def fit_platt(z: np.ndarray, y: np.ndarray, weights: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of a sigmoid on margins z, by Newton steps on smoothed labels."""
    if not len(z):
        return 1.0, 0.0
    n1, n0 = (weights * y).sum(), (weights * (1 - y)).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        g, h = weights * (p - goal), weights * p * (1 - p) + 1e-9
        ga, gb = (g * z).sum() + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (h * z * z).sum() + 1e-3, (h * z).sum(), h.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(abs(da), abs(db), 1.0)
        a, b = a - da / size, b - db / size
        if max(abs(da), abs(db)) < 1e-6:
            break
    return max(float(a), 1e-3), float(b)
