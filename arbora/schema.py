"""Declared schemas: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _B, _I, _L, _D = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.DoubleType()
STRINGS = T.ArrayType(_S)
ALIGNMENT = T.ArrayType(T.StructType([T.StructField("index", _I), T.StructField("en", _S), T.StructField("tr", _S)]))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RECORD = _struct(
    id=_S, project_id=_S, pair_id=_S, source_id=_S, title=_S, text=_S, labels_direct=STRINGS, labels=STRINGS, language=_S, source=_S, license=_S, split=_S,
    taxonomy_version=_S, synthetic_language_variant=_B, content_fingerprint=_S, human_validated=_B, source_label_ids=STRINGS, source_labels=STRINGS,
    variant_of=_S, translation_backend=_S, translation_model=_S, translation_model_revision=_S, translation_source_hash=_S, sentence_alignment=ALIGNMENT, english_source_text=_S,
    original_pair_id=_S, en_id=_S, tr_id=_S, code_switch_strategy=_S, code_switch_strength=_S, primary_language=_S, base_seed=_I,
    original_id=_S, noise_strategy=_S, noise_severity=_S,
)
PREDICTION = _struct(
    text=_S, model=_S, language=_struct(primary=_S, is_code_switched=_B), labels=T.ArrayType(_struct(label=_S, score=_D)), hierarchy_paths=T.ArrayType(STRINGS), ood=_struct(is_ood=_B, score=_D),
    latency_ms=_D, explanation=_struct(important_tokens=STRINGS, details=_S), label_scores=T.MapType(_S, _D), metadata=_S,
)
TAXONOMY = _struct(id=_S, name=_S, parent=_S, description=_S, euroscivoc_code=_S, euroscivoc_path=_S, depth=_I, is_root=_B, is_leaf=_B, is_direct_supported=_B, direct_project_support=_L)
SCORES = _struct(id=_S, scores=T.ArrayType(T.FloatType()))
PROVENANCE = _struct(member=_S, eval_set=_S, input_sha256=_S, records=_L, artifact_sha256=_S, config_sha256=_S, threshold=_D)
