"""Toxicity by multiple-instance learning: labels are known for documents, scores are made for sentences.

A sentence's probability is a logistic function of its tokens' weights; a document's is the noisy-or
of its sentences', 1 - prod(1 - p). The weights are fitted through the noisy-or from document labels
alone, and then point at the sentences that made a document's score. A token's weight is the sum of
hashed buckets of the word, its prefixes and its inner character n-grams, so inflected forms share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, free_name, label_counts, labelled_sample, sigmoid, text_bytes, with_columns_pass

BITS = 17
#: Labelled rows of each class that the fit takes at most.
PER_CLASS = 2000
REMEMBERED = 200_000
_END, _LINE = 4096.0, b"\x01"
_STRIP = b".,;:!?\"'()[]{}*#$%&|<>"


def buckets(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, token number) pairs of raw tokens, by token: the word, and byte 4- and 5-grams of ^word$.

    Case and marks at the ends do not count; tokens without a letter or digit left, and line ends, have none.
    """
    lower = b"\n".join(tokens).decode("utf-8", "replace").lower().encode("utf-8", "replace").split(b"\n")
    words = [b"" if w == _LINE or not (bare := w.strip(_STRIP)) else b"^" + bare + b"$" for w in lower]
    raw = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, words), np.int64, len(words)))
    some = np.fromiter(map(bool, words), bool, len(words))
    column = [(np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint64, len(words))[some] >> np.uint64(32 - BITS)).astype(np.int32)]
    token = [np.flatnonzero(some).astype(np.int32)]
    for n in (4, 5):
        m = len(raw) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | raw[k : k + m]
        inside = owner[:m] == owner[n - 1 :]
        column.append(((code[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
        token.append(owner[:m][inside])
    columns, tokens_ = np.concatenate(column), np.concatenate(token)
    order = np.argsort(tokens_, kind="stable")
    return columns[order], tokens_[order]


def ends_sentence(token: bytes) -> bool:
    return token == _LINE or token.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?")


def tokens_of(text: bytes) -> list[bytes]:
    """Tokens at ASCII white space; a line end is a token of its own."""
    return text.replace(b"\n", b" \x01 ").split()


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -4.0
    slope: float = 1.0
    shift: float = 0.0

    def of(self, tokens: list[bytes]) -> np.ndarray:
        """Weight of each raw token."""
        column, token = buckets(tokens)
        return np.bincount(token, self.weights[column], minlength=len(tokens))

    def combined(self, p: np.ndarray) -> float:
        """Noisy-or of sentence probabilities, calibrated."""
        none = float(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
        odds = np.log(max(-np.expm1(none), 1e-12)) - none
        return float(sigmoid(np.array(self.slope * odds + self.shift)))


class TokenWeights(dict):
    """Raw token -> weight, plus a mark where it ends a sentence; bounded between batches."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def meet(self, texts: list[bytes]) -> list[list[bytes]]:
        """Tokens of texts, whose weights are known from now on."""
        found = [tokens_of(x) for x in texts]
        if len(self) > REMEMBERED:
            self.clear()
        new = [t for t in set().union(*found) if t not in self]
        if new:
            w = np.clip(self.model.of(new), -1000.0, 1000.0) + np.where([ends_sentence(t) for t in new], _END, 0.0)
            self.update(zip(new, w.tolist(), strict=True))
        return found

    def sentences(self, found: list[bytes]) -> np.ndarray:
        """Probability of each sentence of a text's tokens; no token is one empty sentence."""
        if not found:
            return sigmoid(np.array([self.model.bias]))
        w = np.fromiter(map(self.__getitem__, found), np.float64, len(found))
        end = w > _END / 2
        w[end] -= _END
        starts = np.flatnonzero(end[:-1]) + 1
        return sigmoid(np.add.reduceat(w, np.concatenate(([0], starts))) + self.model.bias)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Score of each text."""
        return np.array([self.model.combined(self.sentences(x)) for x in self.meet(texts)], float)


def telling_buckets(codes: list[np.ndarray], column: np.ndarray, begin: np.ndarray, y: np.ndarray, least: float = 3.0) -> np.ndarray:
    """Buckets whose share of documents differs between the labels by `least` standard errors; y is -1 for rows left out.

    codes are the token kinds of each document; column[begin[k]:begin[k + 1]] the buckets of kind k.
    """
    count = np.zeros((2, 1 << BITS), np.int64)
    for row, code in zip(y.tolist(), codes, strict=True):
        if row >= 0:
            parts = [column[begin[k] : begin[k + 1]] for k in np.unique(code).tolist()]
            count[row, np.unique(np.concatenate(parts))] += 1
    n0, n1 = max(int((y == 0).sum()), 1), max(int((y == 1).sum()), 1)
    p = (count.sum(0) + 1) / (n1 + n0 + 2)
    z = (count[1] / n1 - count[0] / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return (np.abs(z) >= least) & (count.sum(0) >= 3)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", steps: int = 250) -> Model:
    """The model from document labels; with no row of one class the score is about the share of label 1."""
    rows = labelled_sample(docs, labels, label_col, per_class, id_col, text_col).selectExpr("cast(_id as string) as id", "_y as y", "_text as text").toArrow()
    n0, n1 = label_counts(labels, label_col, id_col)
    rows = rows.sort_by("id") if rows.num_rows else rows
    return fitted(text_bytes(rows["text"]) if rows.num_rows else [], np.array(rows["y"].to_pylist(), np.int64), n0, n1, steps)


def fitted(texts: list[bytes], y: np.ndarray, n0: int, n1: int, steps: int = 250, rate: float = 0.08, l2: float = 1e-6) -> Model:
    share = min(max(n1 / (n0 + n1), 1e-3), 1 - 1e-3) if n0 + n1 else 1e-3
    if not len(y) or y.min() == y.max():
        return Model(bias=float(np.log(share / (1 - share))))
    kinds: dict[bytes, int] = {}
    codes, cuts, sentences = [], [], []
    at = 0
    for text in texts:
        found = tokens_of(text) or [_LINE]
        codes.append(np.fromiter((kinds.setdefault(t, len(kinds)) for t in found), np.int32, len(found)))
        ends = np.array([ends_sentence(t) for t in found])
        starts = np.concatenate(([0], np.flatnonzero(ends[:-1]) + 1)) + at
        cuts.append(starts)
        sentences.append(len(starts))
        at += len(found)
    cut = np.concatenate(cuts)
    owner = np.repeat(np.arange(len(texts)), sentences)
    column, kind = buckets(list(kinds))
    begin = np.searchsorted(kind, np.arange(len(kinds) + 1))
    held = np.arange(len(y)) % 5 == 4
    keep = telling_buckets(codes, column, begin, np.where(held, -1, y))[column]
    column, kind, size = column[keep], kind[keep], len(kinds)
    code = np.concatenate(codes)
    # only tokens with a telling bucket move a sentence
    live = np.bincount(kind, minlength=size)[code] > 0
    token_sentence = np.repeat(np.arange(len(cut), dtype=np.int32), np.diff(np.append(cut, at)))[live]
    code = code[live]
    balance = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    learn = np.where(held, 0.0, balance)
    learn /= learn.sum()
    w, b = np.zeros(1 << BITS), -5.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0

    def forward() -> tuple[np.ndarray, np.ndarray]:
        weight = np.bincount(kind, w[column], minlength=size)
        p = sigmoid(np.bincount(token_sentence, weight[code], minlength=len(cut)) + b)
        return p, np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))

    for t in range(1, steps + 1):
        p, none = forward()
        doc = -np.expm1(none)
        # d loss / d log(1 - P): for label 1, -log P falls as none falls; for label 0 the loss is -none
        slope = np.where(y == 1, np.exp(none) / np.maximum(doc, 1e-9), -1.0) * learn
        g = slope[owner] * -p  # d none / d margin = -p
        gw = np.bincount(column, np.bincount(code, g[token_sentence], minlength=size)[kind], minlength=len(w)) + l2 * w
        gb = float(g.sum())
        m += 0.1 * (gw - m)
        s += 0.01 * (gw * gw - s)
        mb += 0.1 * (gb - mb)
        sb += 0.01 * (gb * gb - sb)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-7)
    _, none = forward()
    from .features import fit_platt

    odds = np.log(np.maximum(-np.expm1(none), 1e-12)) - none
    part = held if min((y[held] == 0).sum(), (y[held] == 1).sum()) > 4 else np.ones(len(y), bool)
    slope, shift = fit_platt(odds[part], y[part].astype(float), balance[part] * len(y))
    return Model(w.astype(np.float32), float(b), slope, shift)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text; null and empty texts are one empty sentence."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    weights = TokenWeights(model)

    def work(batch: pa.RecordBatch) -> dict:
        found = weights.documents(text_bytes(batch.column(1)))
        return {id_col: batch.column(0), "score": found, "predicted": (found >= threshold).astype(np.int32)}

    return arrow_pass(docs, [id_col, text_col], schema, work)


def offending_sentences(docs: DataFrame, model: Model, at_least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence, p, text): the sentences, by number from 0, whose own probability is at_least or more."""
    weights = TokenWeights(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("sentence", T.IntegerType()), T.StructField("p", T.DoubleType()), T.StructField("text", T.StringType())])

    def work(batch: pa.RecordBatch) -> dict:
        rows: list[int] = []
        number: list[int] = []
        p: list[float] = []
        said: list[str] = []
        for row, tokens in enumerate(weights.meet(text_bytes(batch.column(1)))):
            scores = weights.sentences(tokens)
            if not (scores >= at_least).any():
                continue
            sentences: list[list[bytes]] = [[]]
            for token in tokens:
                sentences[-1].append(token)
                if ends_sentence(token):
                    sentences.append([])
            for k in np.flatnonzero(scores >= at_least).tolist():
                rows.append(row)
                number.append(k)
                p.append(float(scores[k]))
                said.append(b" ".join(t for t in sentences[k] if t != _LINE).decode("utf-8", "replace"))
        return {id_col: batch.column(0).take(pa.array(rows, pa.int64())), "sentence": pa.array(number, pa.int32()), "p": pa.array(p, pa.float64()), "text": pa.array(said, pa.string())}

    return arrow_pass(docs, [id_col, text_col], schema, work)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows that score threshold or more; columns and other rows stay as they are."""
    weights = TokenWeights(model)
    name = free_name(docs, "_toxic")

    def work(texts: list[bytes]) -> dict:
        return {name: weights.documents(texts)}

    return with_columns_pass(docs, text_col, T.StructType([T.StructField(name, T.DoubleType())]), work).where(F.col(name) < threshold).drop(name)
