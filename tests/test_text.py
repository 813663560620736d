"""Text functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from arbora.functions import arrays, noise, text


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("  a  b\nc ", "a b c"), ("a b", "a b"), ("\x1ca\x1f", "a"), ("", ""), (None, None)])
def test_normalize(spark, given, want):
    assert one(spark, text.normalize_text("t"), t=given) == want


def test_clean_record(spark):
    assert one(spark, text.clean_record_text("t"), t="<p>Laser <b>optics</b></p>") == "Laser optics"
    assert one(spark, text.clean_record_text("t"), t="&lt;b&gt;x &eacute;") == "<b>x é"
    assert one(spark, text.clean_record_text("t", full_entities=False), t="&amp;lt;x&nbsp;y") == "&lt;x y"
    assert one(spark, text.clean_record_text("t"), t=None) == ""


def test_prefixes_and_slug(spark):
    assert one(spark, text.code_prefixes("t"), t="/23/53/365") == ["/23", "/23/53", "/23/53/365"]
    assert one(spark, text.code_prefixes("t"), t="") == []
    assert one(spark, text.slug("t"), t="Earth & Space") == "earth_space"


def test_turkish_lower(spark):
    assert one(spark, text.turkish_safe_lower("t"), t="İSTANBUL") == "istanbul"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("See Fig. 2 for it. Then go.", ["See Fig. 2 for it.", "Then go."]),
        ("It uses lasers.As planned.", ["It uses lasers.", "As planned."]),
        ("It uses 5G.As planned.", ["It uses 5G.As planned."]),
        ("tech- niques work", ["techniques work"]),
        ("alone", ["alone"]),
        ("   ", []),
        ("", []),
    ],
)
def test_sentences(spark, given, want):
    assert one(spark, text.segment_sentences("t"), t=given) == want


def test_chunks(spark):
    assert one(spark, text.chunk_sentence("t", 3), t="a b, c d, e") == ["a b,", "c d, e"]
    assert one(spark, text.chunk_sentence("t", 2), t="a b c d e") == ["a b", "c d", "e"]
    assert one(spark, text.chunk_sentence("t", 9), t="a b") == ["a b"]


def test_translation_screens(spark):
    assert one(spark, text.translation_issues("a", "b"), a="Hi there", b=" ") == ["empty"]
    assert one(spark, text.translation_issues("a", "b"), a="Hi there", b="hi THERE") == ["identical"]
    assert one(spark, text.translation_issues("a", "b"), a="Hi there you", b="x") == ["length_ratio"]
    assert one(spark, text.translation_issues("a", "b"), a="abc", b="a\x01c") == ["control_characters"]


def test_language(spark):
    made = lambda **m: spark.range(1).select(text.primary_language(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])).alias("x")).first()["x"]
    assert made(en=1) == "und"
    assert made(en=8, tr=3) == "en-tr"
    assert made(en=20, tr=2) == "en"


def test_ratios(spark):
    row = spark.sql("select 1 a, 0 b").select(arrays.ratio("a", "b").alias("x"), arrays.ratio("b", "a").alias("y")).first()
    assert tuple(row) == (0.0, 0.0)
    assert spark.range(1).select(arrays.is_probability(F.lit(float("nan"))).alias("x")).first()["x"] is False


def test_map_labels(spark):
    df = spark.createDataFrame([(["sports", "politics", "sports"],)], "l array<string>")
    assert df.select(arrays.map_labels("l", {"sports": "sport", "politics": "politics"}).alias("x")).first()["x"] == ["sport", "politics"]
    with pytest.raises(Exception, match="unknown label"):
        df.select(arrays.map_labels("l", {"sports": "sport"}).alias("x")).collect()


@pytest.mark.parametrize("strategy", sorted(noise.STRATEGIES))
@pytest.mark.parametrize("given", ["The quick brown fox.", "a", "!!", "çok güzel", "aa bb", "x" * 500])
def test_noise_changes_and_repeats(strategy, given):
    first = noise.perturbed(given, "r1", strategy, "medium", 42, "tr")
    assert first and first.strip() == first and first != given
    assert first == noise.perturbed(given, "r1", strategy, "medium", 42, "tr")


def test_noise_refuses():
    with pytest.raises(ValueError):
        noise.severity_of("heavy")
    with pytest.raises(ValueError):
        noise.severity_of(0)
    with pytest.raises(ValueError):
        noise.perturbed("x", "r", "turkish_diacritics", language="en")
    with pytest.raises(ValueError):
        noise.perturbed("  ", "r")


def test_noise_column(spark):
    df = spark.createDataFrame([("a", "some text here"), ("b", None), ("c", " ")], "id string, text string")
    got = {r["id"]: r["x"] for r in df.select("id", noise.perturb("text", "id").alias("x")).collect()}
    assert got["b"] is None and got["c"] is None and got["a"] == noise.perturbed("some text here", "a")


def test_sentences_are_cut_once(spark, sf):
    """Each regular expression is in the plan once, so a text is cut once."""
    from arbora import catalog

    made = catalog.queries()["segment_sentences"](spark, sf)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("md5(") == 1
    texts = [(1, None), (2, " "), (3, "."), (4, "One. Two e.g. x. Three")]
    got = spark.createDataFrame(texts, "i int, t string").select("i", text.segment_sentences("t").alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [[None], [], ["."], ["One.", "Two e.g. x.", "Three"]]
