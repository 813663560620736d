"""Derived variants: code-switched and noisy records, and a mock translator."""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import perturb
from ..functions.text import normalize_text, seed_hex, segment_sentences, space_tokens, translation_issues

STRATEGIES = ("sentence_mix", "chunk_mix", "interleave")
STRENGTHS = ("balanced", "light")
#: The mock translator's words, and the frame it puts a sentence into.
TERMS = {
    "project": "proje", "research": "araştırma", "science": "bilim", "system": "sistem", "technology": "teknoloji", "development": "geliştirme", "data": "veri",
    "analysis": "analiz", "european": "avrupa", "energy": "enerji", "health": "sağlık", "environment": "çevre", "network": "ağ", "model": "model",
    "objective": "amaç", "method": "yöntem", "results": "sonuçlar", "new": "yeni", "clinical": "klinik", "artificial": "yapay", "intelligence": "zeka",
}
FRAME = ("Bu araştırma kapsamında ", " geliştirilmektedir.")


def mock_translate(sentence: Column | str) -> Column:
    """Known words replaced, the whole in a fixed frame; a blank sentence is empty."""
    table = F.create_map(*[F.lit(x) for kv in TERMS.items() for x in kv])
    word = lambda w: F.coalesce(F.try_element_at(table, F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}_]", "")), w)
    tokens = space_tokens(sentence)
    body = F.array_join(F.transform(tokens, word), " ")
    return F.when(F.size(tokens) == 0, "").otherwise(F.concat(F.lit(FRAME[0]), body, F.lit(FRAME[1])))


def translate(records: DataFrame, translator: Callable[[Column], Column] = mock_translate, text: str = "text") -> DataFrame:
    """Adds sentence_alignment, translated text, its source's hash and the quality issues; the translator is a plug-in."""
    pairs = F.transform(segment_sentences(text), lambda s, i: F.struct(i.alias("index"), s.alias("en"), translator(s).alias("tr")))
    made = records.withColumn("sentence_alignment", pairs)
    joined = F.array_join(F.transform("sentence_alignment", lambda p: p["tr"]), " ")
    return made.withColumns({"translated": joined, "translation_source_hash": F.sha2(text, 256), "translation_issues": translation_issues(F.col(text), joined)})


def first_draw(seed: Column) -> Column:
    """The first number of a generator with a 64-bit seed given in hex (Arrow)."""

    @F.pandas_udf("double")
    def draw(x: pd.Series) -> pd.Series:
        return x.map(lambda s: random.Random(int(s, 16)).random())

    return draw(seed)


def primary_side(pair: Column | str, strategy: str, strength: str, base_seed: int = 42) -> Column:
    """en or tr, by the seeded draw of a pair."""
    key = F.col(pair) if isinstance(pair, str) else pair
    return F.when(first_draw(seed_hex(key, strategy, strength, base_seed)) < 0.5, "en").otherwise("tr")


def mix_sentences(pairs: Column | str, primary: Column | str, strategy: str = "sentence_mix", strength: str = "balanced") -> Column:
    """Aligned sentences as one text of both languages; pairs is an array of (index, en, tr), primary en or tr.

    Mixing takes the primary side of even sentences (light: of all but every second of three); chunk_mix of the
    first half (light: of the first three quarters). A single sentence is half of one and half of the other.
    """
    if strategy not in STRATEGIES or strength not in STRENGTHS:
        raise ValueError("unknown strategy or strength")
    a, en = (F.col(pairs) if isinstance(pairs, str) else pairs), (F.col(primary) if isinstance(primary, str) else primary) == "en"
    n = F.size(a)
    one = F.lit(1)
    if strategy == "chunk_mix":
        edge = F.greatest(one, F.floor(n / 2) if strength == "balanced" else F.floor(n * 3 / 4))
        keeps = lambda i: i < edge
    else:
        keeps = (lambda i: i % 2 == 0) if strength == "balanced" else (lambda i: i % 3 != 1)
    side = lambda p, first: F.when(first == en, p["en"]).otherwise(p["tr"])
    mixed = F.array_join(F.transform(a, lambda p, i: side(p, keeps(i))), " ")
    only = F.element_at(a, 1)
    head, tail = space_tokens(side(only, F.lit(True))), space_tokens(side(only, F.lit(False)))
    cut = lambda t: F.greatest(one, F.floor(F.size(t) / 2)).cast("int")
    halves = F.array_join(F.concat(F.slice(head, one, cut(head)), F.slice(tail, cut(tail) + 1, F.size(tail) + 1)), " ")
    return F.when(n == 0, F.raise_error(F.lit("no aligned sentences"))).when(n == 1, F.trim(halves)).otherwise(F.trim(mixed))


def zipped_sentences(en: Column | str, tr: Column | str) -> Column:
    """Sentences of two texts side by side, as many as the shorter has."""
    a, b = segment_sentences(en), segment_sentences(tr)
    n = F.least(F.size(a), F.size(b))
    return F.transform(F.slice(a, F.lit(1), n), lambda s, i: F.struct(i.alias("index"), s.alias("en"), F.get(b, i).alias("tr")))


def code_switched(en: DataFrame, tr: DataFrame, strategy: str = "sentence_mix", strength: str = "balanced", base_seed: int = 42) -> DataFrame:
    """Mixed records of pairs (pair_id) that agree in split, labels and direct labels (where both tables have them); others are an error where the row is read."""
    direct = "labels_direct" in en.columns and "labels_direct" in tr.columns
    b = tr.select("pair_id", F.col("id").alias("tr_id"), F.col("text").alias("_tr"), F.col("split").alias("_split"), F.col("labels").alias("_labels"), *(["sentence_alignment"] if "sentence_alignment" in tr.columns else []), *([F.col("labels_direct").alias("_direct")] if direct else []))
    met = en.drop("sentence_alignment").join(b, "pair_id")
    zipped = zipped_sentences("text", "_tr")
    pairs = F.when(F.size("sentence_alignment") > 0, F.col("sentence_alignment")).otherwise(zipped) if "sentence_alignment" in tr.columns else zipped
    same = F.col("split").eqNullSafe(F.col("_split")) & F.col("labels").eqNullSafe(F.col("_labels"))
    if direct:
        same &= F.col("labels_direct").eqNullSafe(F.col("_direct"))
    staged = met.withColumns({"_pairs": F.when(same, pairs).otherwise(F.raise_error(F.concat(F.lit("unlike pair "), F.col("pair_id")))), "primary_language": primary_side("pair_id", strategy, strength, base_seed)})
    return staged.select(
        F.concat_ws(":", "pair_id", F.lit("codeswitch"), F.lit(strategy), F.lit(strength)).alias("id"), "pair_id", F.col("id").alias("en_id"), "tr_id", mix_sentences("_pairs", "primary_language", strategy, strength).alias("text"),
        "labels", "split", F.lit("en-tr").alias("language"), F.lit(strategy).alias("code_switch_strategy"), F.lit(strength).alias("code_switch_strength"), "primary_language", F.lit(base_seed).alias("base_seed"),
    )


def noisy(records: DataFrame, strategy: str = "combined", severity: str | float = "medium", base_seed: int = 42, language: str = "en") -> DataFrame:
    """Noisy copies of records with their lineage; rows with blank texts are left out."""
    kept = records.where(normalize_text("text") != "")
    made = kept.withColumns({"text": perturb("text", "id", strategy, severity, base_seed, language), "original_id": F.col("id"), "noise_strategy": F.lit(strategy), "noise_severity": F.lit(str(severity)), "base_seed": F.lit(base_seed)})
    return made.withColumn("id", F.concat_ws(":", "id", F.lit("noise"), F.lit(strategy), F.lit(str(severity))))
