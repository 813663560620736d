"""Arrays, maps, ratios and probabilities as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def is_probability(x: Column | str) -> Column:
    """Not null, not NaN, from 0 to 1."""
    return F.coalesce(_c(x).between(0, 1) & ~F.isnan(_c(x)), F.lit(False))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def clipped(x: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x)))


def label_set(x: Column | str) -> Column:
    """Canonical form of a label set: sorted, without repeats."""
    return F.array_sort(F.array_distinct(_c(x)))


def map_labels(labels: Column | str, aliases: Mapping[str, str]) -> Column:
    """Canonical ids of aliases, first-seen order, without repeats; an unknown alias is an error."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    known = lambda x: F.coalesce(F.try_element_at(table, x), F.raise_error(F.concat(F.lit("unknown label: "), x)))
    return F.array_distinct(F.transform(_c(labels), known))


def merged_tokens(lists: Column | str) -> Column:
    """Token lists as one, first-seen order."""
    return F.array_distinct(F.flatten(_c(lists)))


def l2_normalized(v: Column | str) -> Column:
    """A vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(_c(v), lambda x: x.cast("double") / norm)).otherwise(F.transform(_c(v), lambda x: x.cast("double")))


def json_path(text: Column | str, path: str) -> Column:
    """A value of a JSON string; a missing one is an error."""
    return F.coalesce(F.get_json_object(_c(text), path), F.raise_error(F.lit(f"no value at {path}")))


def rounded(x: Column | str, places: int = 4) -> Column:
    """Half-even rounding."""
    return F.bround(_c(x), places)


def merged(base: Mapping[str, object], over: Mapping[str, object]) -> dict[str, object]:
    """Settings of over on those of base, mapping by mapping; any other value replaces the old one whole."""
    both = lambda k: isinstance(base.get(k), Mapping) and isinstance(over[k], Mapping)
    return {**base, **{k: merged(base[k], v) if both(k) else v for k, v in over.items()}}
