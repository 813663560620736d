"""Quality rules: counted base rules, then a calibrated hashed n-gram logistic regression.

The classifier is fitted on a bounded sample of labelled rows, calibrated on rows it has not seen
(Platt's sigmoid) and scored in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_pass, label_counts, labelled_sample, text_bytes
from .features import Linear, Rows, TokenIds, fit_logistic, fit_platt, gathered, unpacked

#: Labelled rows of each class that the fit takes at most.
PER_CLASS = 2000
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Fixed thresholds."""

    min_words: int = 20
    max_repeat_percent: int = 30
    min_quality: float = 0.5


def repeated_words(words: list[bytes], ids: dict[bytes, int] | None = None, window: int = WINDOW) -> int:
    """Words that lie in a window of words which occurs twice or more, the first occurrence included."""
    n = len(words)
    m = n - window + 1
    if m < 2:
        return 0
    seen: dict[bytes, int] = {}
    code = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
    if len(seen) == n:
        return 0
    mixed = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(m, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0xD1342543DE82EF95) + mixed[k : k + m]
    rolled ^= rolled >> np.uint64(32)
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    change[:m] += twice
    change[window : window + m] -= twice
    return int((np.cumsum(change[:n]) > 0).sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    letters = b"".join(words)
    continued = int(np.count_nonzero((np.frombuffer(letters, np.uint8) & 0xC0) == 0x80)) if letters and not letters.isascii() else 0
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    return (
        len(words),
        len(letters) - continued,
        sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Linear:
    """A calibrated model; with no row of one class, its score is the share of label 1 (0.5 without rows)."""
    rows = gathered(labelled_sample(docs, labels, label_col, per_class, id_col, text_col))
    n0, n1 = label_counts(labels, label_col, id_col)
    return fitted(rows, n0, n1)


def fitted(rows: Rows, n0: int, n1: int) -> Linear:
    here = np.array([(rows.y == 0).sum(), (rows.y == 1).sum()])
    share = n1 / (n0 + n1) if n0 + n1 else 0.5
    if here.min() < 2:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Linear(bias=float(np.log(p / (1 - p))))
    weights = np.where(rows.y == 1, share / here[1], (1 - share) / here[0]) * len(rows)
    held = np.arange(len(rows)) % 4 == 3
    train = rows.take(np.flatnonzero(~held))
    if min((train.y == 0).sum(), (train.y == 1).sum()) == 0:
        train, held = rows, np.zeros(len(rows), bool)
    model = fit_logistic(train, weights[~held] if len(train) < len(rows) else weights)
    kept = np.flatnonzero(held)
    slope, shift = fit_platt((rows.take(kept).times(model.w) + model.b) if len(kept) else np.zeros(0), rows.y[kept], weights[kept])
    return unpacked(model.w, model.b, slope, shift)


def score_quality(docs: DataFrame, model: Linear, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """Per document: id, the base counts, base_failed, quality (calibrated) and kept.

    kept is false if a base rule fails, else quality >= rules.min_quality. Null text is empty, and
    fails for its words; repeated rows each get their row.
    """
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    )
    ids = TokenIds()

    def work(batch: pa.RecordBatch) -> dict:
        counts, z = [], []
        for text in text_bytes(batch.column(1)):
            words = text.split()
            counts.append(base_counts(text, words))
            z.append(model.margin(text, words, ids))
        table = np.array(counts, np.int64)
        failed = (table[:, 0] < rules.min_words) | (100 * table[:, 4] > rules.max_repeat_percent * table[:, 0])
        quality = model.probability(np.array(z))
        return {id_col: batch.column(0), **{c: table[:, k] for k, c in enumerate(longs)}, "base_failed": failed, "quality": quality, "kept": ~failed & (quality >= rules.min_quality)}

    return arrow_pass(docs.select(id_col, text_col), [id_col, text_col], schema, work)
