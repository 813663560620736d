"""Audits as data: a rule is a name and a predicate, an audit is a table of the rows that break rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_fingerprint, normalize_text, translation_issues, without_space
from .joins import leakage, pair_problems

#: Languages and splits that a record may have.
LANGUAGES = ("en", "tr", "en-tr")
SPLITS = ("train", "validation", "test")
#: The source whose records come in pairs, and the prefix of their pair ids.
PAIRED_SOURCE, PAIR_PREFIX = "cordis_h2020", "cordis"
Rule = tuple[str, Column]


def blank(c: str) -> Column:
    return F.coalesce(normalize_text(c) == "", F.lit(True))


def broken(rules: Sequence[Rule]) -> Column:
    """Names of the rules whose predicate does not hold (null counts as broken)."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules)), lambda x: x.isNotNull())


def audit(df: DataFrame, rules: Sequence[Rule], id_col: str = "id") -> DataFrame:
    """(rule, row_id): a row for each broken rule."""
    return df.select(F.explode(broken(rules)).alias("rule"), F.col(id_col).alias("row_id"))


def require(violations: DataFrame, what: str) -> None:
    """Raises with the first violations if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: " + "; ".join(str(tuple(r)) for r in found))


def record_rules(allowed: Column | None = None) -> list[Rule]:
    """Rules of a record (RECORD): required fields, ids, text, label sets, language, source identity, license, split.

    allowed is an array column of the labels of the tree.
    """
    labels, direct = F.col("labels"), F.col("labels_direct")
    items = lambda x: ~F.exists(x, lambda i: i.isNull() | (F.trim(i) == ""))
    distinct = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    own = F.col("source") != PAIRED_SOURCE
    rules: list[Rule] = [
        ("id", ~blank("id") & ~F.col("id").contains("::")),
        ("text", ~blank("text")),
        ("labels_missing", labels.isNotNull() & (F.size(labels) > 0)),
        ("labels_repeated", labels.isNull() | distinct(labels)),
        ("labels_blank", labels.isNull() | items(labels)),
        ("direct_empty", direct.isNull() | (F.size(direct) > 0)),
        ("direct_blank", direct.isNull() | items(direct)),
        ("direct_not_closed", direct.isNull() | labels.isNull() | (F.size(F.array_except(direct, labels)) == 0)),
        ("language", F.col("language").isin(*LANGUAGES)),
        ("source", ~blank("source")),
        ("project_identity", own | (~blank("project_id") & (F.col("pair_id") == F.concat(F.lit(f"{PAIR_PREFIX}:"), "project_id")))),
        ("direct_unique", own | (direct.isNotNull() & distinct(direct))),
        ("license", ~blank("license")),
        ("split", F.col("split").isin(*SPLITS)),
    ]
    if allowed is not None:
        rules += [("labels_unknown", labels.isNull() | (F.size(F.array_except(labels, allowed)) == 0)), ("direct_unknown", direct.isNull() | (F.size(F.array_except(direct, allowed)) == 0))]
    return rules


def prediction_rules() -> list[Rule]:
    """Rules of a prediction: language code, labels unique and not blank, probabilities, latency."""
    labels, p = F.col("labels"), lambda x: x.between(0, 1) & ~F.isnan(x)
    return [
        ("language", ~blank("language.primary")),
        ("labels_blank", ~F.exists(labels, lambda x: F.trim(x["label"]) == "")),
        ("labels_repeated", F.size(F.array_distinct(F.transform(labels, lambda x: x["label"]))) == F.size(labels)),
        ("score", ~F.exists(labels, lambda x: ~p(x["score"]))),
        ("ood_score", F.col("ood.score").isNull() | p(F.col("ood.score"))),
        ("latency", F.col("latency_ms").isNull() | ((F.col("latency_ms") >= 0) & (F.col("latency_ms") < float("inf")))),
    ]


def partition_audit(records: DataFrame, nodes: DataFrame, closed: DataFrame, version: str) -> DataFrame:
    """(rule, row_id) of a partition: record rules, unique ids, tree version, direct labels supported, labels their exact closure."""
    tree = F.broadcast(nodes.agg(F.collect_set("id").alias("_all"), F.collect_set(F.when(F.col("is_direct_supported"), F.col("id"))).alias("_direct")))  # one row: a tree's ids
    direct = records.select("id", F.explode("labels_direct").alias("label")).join(closed.select("label", "ancestor"), "label", "left").groupBy("id").agg(F.array_sort(F.collect_set(F.coalesce("ancestor", "label"))).alias("_closure"))
    met = records.crossJoin(tree).join(direct, "id", "left")
    rules = [
        *record_rules(F.col("_all")),
        ("tree_version", F.col("taxonomy_version") == version),
        ("direct_unsupported", F.col("labels_direct").isNull() | (F.size(F.array_except("labels_direct", "_direct")) == 0)),
        ("not_the_closure", F.array_sort("labels") == F.col("_closure")),
    ]
    twice = records.groupBy("id").count().where("count > 1").select(F.lit("repeated_id").alias("rule"), F.col("id").alias("row_id"))
    return audit(met, rules).unionByName(twice)


def source_audit(records: DataFrame, split_map: DataFrame) -> DataFrame:
    """(rule, row_id) of source-language records: identity, the split map, the text's fingerprint, leakage between splits."""
    met = records.join(split_map.select("project_id", F.col("split").alias("_split")), "project_id", "full_outer")
    rules = [
        ("identity", F.col("id").isNull() | (F.col("id") == F.concat("pair_id", F.lit(":"), "language"))),
        ("split_map", F.col("split").eqNullSafe(F.col("_split"))),
        ("fingerprint", F.col("content_fingerprint").isNull() | (F.col("content_fingerprint") == content_fingerprint("text"))),
    ]
    found = audit(met.withColumn("row_id", F.coalesce("id", "project_id")), rules, "row_id")
    shared = leakage(records, ["id", "pair_id", "project_id", "content_fingerprint"]).select(F.concat(F.lit("leak_"), "key").alias("rule"), F.col("value").alias("row_id"))
    return found.unionByName(shared)


def unseen_labels(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(label): supported labels without a training record."""
    seen = records.where("split = 'train'").select(F.explode("labels_direct").alias("label"))
    return labels.select("label").distinct().join(seen, "label", "left_anti")


def translation_audit(translated: DataFrame, source: DataFrame) -> DataFrame:
    """(rule, row_id) of translated records against their sources: pairing, fields, source hash, alignment, quality."""
    pairs = pair_problems(source, translated, "project_id", ["split", "labels", "labels_direct"]).select(F.col("problem").alias("rule"), F.col("project_id").alias("row_id"))
    s = source.select("project_id", F.col("id").alias("_en_id"), F.col("text").alias("_en"))
    met = translated.join(s, "project_id")
    side = lambda name: F.array_join(F.transform("sentence_alignment", lambda p: p[name]), " ")
    rules = [
        ("variant_of", F.col("variant_of") == F.col("_en_id")),
        ("source_hash", F.col("translation_source_hash") == F.sha2("_en", 256)),
        ("alignment_missing", F.size("sentence_alignment") > 0),
        ("alignment_order", F.transform("sentence_alignment", lambda p: p["index"]) == F.sequence(F.lit(0), F.size("sentence_alignment") - 1)),
        ("alignment_source", without_space(side("en")) == without_space("_en")),
        ("alignment_target", without_space(side("tr")) == without_space("text")),
        ("quality", F.size(translation_issues("_en", "text")) == 0),
    ]
    return pairs.unionByName(audit(met, rules))


def regenerated(stored: DataFrame, made: DataFrame) -> DataFrame:
    """Rows in which a stored derived table and its regeneration differ: (side, columns)."""
    from .joins import set_difference

    return set_difference(stored, made.select(*stored.columns))


def manifest_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(rule, path): files (path, sha256, bytes) that a manifest (same columns) names otherwise, or not at all."""
    a = manifest.select("path", F.col("sha256").alias("want"), F.col("bytes").alias("size"))
    met = a.join(files.select("path", "sha256", "bytes"), "path", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("want") != F.col("sha256"), "hash").when(F.col("size") != F.col("bytes"), "bytes")
    return met.select(problem.alias("rule"), "path").where("rule is not null")


def prune_to_fixpoint(rows: DataFrame, min_positives: int, rounds: int = 50) -> DataFrame:
    """(row, label) pruned until every label has min_positives rows with and without it; an error if it takes over `rounds` rounds."""
    now = rows.select("row", "label").distinct()
    size = now.count()
    for _ in range(rounds):
        n = now.agg(F.count_distinct("row").alias("n"))
        good = now.groupBy("label").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).where((F.col("c") >= min_positives) & (F.col("n") - F.col("c") >= min_positives)).select("label")
        new = now.join(good, "label", "left_semi").select("row", "label").checkpoint()
        left = new.count()
        now = new
        if left == size:
            return now
        size = left
    raise ValueError("no fixpoint")
