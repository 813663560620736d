"""Quality from positive and unlabelled rows: non-negative unbiased risk (nnPU).

Trusted positives are rows labelled 1; the unlabelled rows are a bounded hash sample of all
documents, labelled or not, and rows labelled 0 are never looked at. The share of positives among
the unlabelled rows is estimated from scores of a first positive-against-unlabelled fit on rows it
has not seen: the smallest ratio of the two tails, with a sampling margin. The model then minimises

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss; where the second part is negative, its gradient is turned round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, crc_fold, labelled_sample, sigmoid, text_bytes
from .features import Adam, Linear, Rows, TokenIds, fit_logistic, fit_platt, gathered, unpacked

#: Trusted positives, and unlabelled rows, that the fit takes at most.
POSITIVES, UNLABELLED = 2500, 3500


def estimated_prior(z_p: np.ndarray, z_u: np.ndarray, margin: float = 0.1) -> float:
    """Share of positives among the unlabelled: the least ratio of tails that has enough positives."""
    if not len(z_p) or not len(z_u):
        return 0.5
    z_p, z_u = np.sort(z_p), np.sort(z_u)
    cuts = np.unique(z_p)
    q_p = 1 - np.searchsorted(z_p, cuts, "left") / len(z_p)
    q_u = 1 - np.searchsorted(z_u, cuts, "left") / len(z_u)
    slack = np.sqrt(np.log(4 / margin) / 2) * (1 / np.sqrt(len(z_p)) + 1 / np.sqrt(len(z_u)))
    enough = q_p >= 0.1
    at = np.argmin(((q_u + slack) / q_p)[enough])
    return float(np.clip((q_u / q_p)[enough][at], 0.02, 0.98))


def fit_nnpu(p: Rows, u: Rows, prior: float, steps: int = 160, rate: float = 0.3, l2: float = 1e-6) -> tuple[Adam, float]:
    """The model, and its non-negative risk at the end."""
    model, risk = Adam(rate, l2), 0.0
    model.b = float(np.log(prior / (1 - prior)))
    for _ in range(steps):
        z_p, z_u = p.times(model.w) + model.b, u.times(model.w) + model.b
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        risk = prior * np.logaddexp(0, -z_p).mean() + max(0.0, negative)
        d_p, d_u = sigmoid(z_p) / len(p), sigmoid(z_u) / len(u)
        if negative >= 0:
            g_p, g_u = prior * (sigmoid(z_p) - 1) / len(p) - prior * d_p, d_u
        else:
            g_p, g_u = prior * d_p, -d_u
        model.step(p.back(g_p) + u.back(g_u), float(g_p.sum() + g_u.sum()))
    return model, float(risk)


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[Linear, float]:
    """(model, estimated prior). Without positives or documents every score is 0.5."""
    p = gathered(labelled_sample(docs, labels.where(F.col(label_col) == 1), label_col, positives, id_col, text_col))
    ids = docs.where(F.col(id_col).isNotNull() & (crc_fold(id_col) != 2)).select(F.col(id_col).alias("_id")).distinct()
    chosen = F.broadcast(ids.orderBy(F.xxhash64(F.lit("u"), "_id"), "_id").limit(unlabelled))  # bounded by the parameter
    u = gathered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id").withColumn("_y", F.lit(0)))
    return fitted(p, u)


def fitted(p: Rows, u: Rows) -> tuple[Linear, float]:
    if len(p) < 4 or len(u) < 4:
        return Linear(), 0.5
    half_p, half_u = np.arange(len(p)) % 3 == 2, np.arange(len(u)) % 3 == 2
    p0, u0, p1, u1 = (r.take(np.flatnonzero(m)) for r, m in ((p, ~half_p), (u, ~half_u), (p, half_p), (u, half_u)))
    both = Rows(
        np.concatenate([p0.columns, u0.columns]), np.concatenate([p0.values, u0.values]),
        np.concatenate([p0.starts, u0.starts[1:] + p0.starts[-1]]), np.concatenate([np.ones(len(p0)), np.zeros(len(u0))]), np.concatenate([p0.ids, u0.ids]),
    )
    first = fit_logistic(both, np.where(both.y == 1, 0.5 / len(p0), 0.5 / len(u0)), steps=40)
    prior = estimated_prior(p1.times(first.w) + first.b, u1.times(first.w) + first.b)
    model, _ = fit_nnpu(p0, u0, prior)
    # calibration on unseen rows: positives weigh prior; unlabelled rows count against minus their share of positives
    z_p, z_u = p1.times(model.w) + model.b, u1.times(model.w) + model.b
    doubt = 1 - sigmoid(z_u)
    z = np.concatenate([z_p, z_u])
    y = np.concatenate([np.ones(len(z_p)), np.zeros(len(z_u))])
    weights = np.concatenate([np.full(len(z_p), prior / len(z_p)), doubt / max(doubt.sum(), 1e-9) * (1 - prior)]) * len(z)
    slope, shift = fit_platt(z, y, weights)
    return unpacked(model.w, model.b, slope, shift), prior


def score(docs: DataFrame, model: Linear, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text, empty and null ones included; rows repeat as given."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    ids = TokenIds()

    def work(batch: pa.RecordBatch) -> dict:
        z = np.array([model.margin(x, x.split(), ids) for x in text_bytes(batch.column(1))])
        found = model.probability(z)
        return {id_col: batch.column(0), "score": found, "predicted": (found >= threshold).astype(np.int32)}

    return arrow_pass(docs, [id_col, text_col], schema, work)
