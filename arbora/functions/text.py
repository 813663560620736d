"""Text and hash scalars as Column expressions."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a Unicode-aware regex: Java's (?U)\s lacks the four separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"
WORD = r"[\p{L}\p{N}_]+"
SYMBOL = r"[^\p{L}\p{N}_\s]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_text(text: Column | str) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(text), SPACE, " "))


def html_unescape(text: Column | str) -> Column:
    """All HTML entities (Arrow): there is no built-in for the full table."""

    @F.pandas_udf("string")
    def unescape(x: pd.Series) -> pd.Series:
        return x.map(html.unescape, na_action="ignore")

    return unescape(_c(text))


def unescape_basic(text: Column | str) -> Column:
    """The six common entities, the ampersand last so that a double-escaped one is undone once only."""
    out = _c(text)
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return out


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"<[^>]+>", " ")


def clean_record_text(text: Column | str, full_entities: bool = True) -> Column:
    """Null is empty; tags become spaces, then entities are undone (so an escaped tag stays as text), then normalised."""
    bare = strip_tags(F.coalesce(_c(text), F.lit("")))
    return normalize_text(html_unescape(bare) if full_entities else unescape_basic(bare))


def content_fingerprint(text: Column | str, full_entities: bool = True) -> Column:
    """SHA-256 of the cleaned text in lower case."""
    return F.sha2(normalize_text(F.lower(clean_record_text(text, full_entities))), 256)


def turkish_safe_lower(text: Column | str) -> Column:
    """Lower case in which a dotted capital I gives one letter."""
    return F.lower(F.replace(_c(text), F.lit("İ"), F.lit("i")))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), F.lit(0))


def word_and_symbol_tokens(text: Column | str) -> Column:
    """Words, and each other visible sign, case kept."""
    return F.regexp_extract_all(_c(text), F.lit(f"{WORD}|{SYMBOL}"), F.lit(0))


def space_tokens(text: Column | str) -> Column:
    return F.filter(F.split(normalize_text(text), " "), lambda x: x != "")


def without_space(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), SPACE, "")


def slug(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(name)), "[^a-z0-9]+", "_")


def code_prefixes(code: Column | str) -> Column:
    """/a/b/c -> [/a, /a/b, /a/b/c]."""
    parts = F.filter(F.split(_c(code), "/"), lambda x: x != "")
    ends = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda d: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, d), "/")))


# ---------------------------------------------------------------- hashes


def seed_hex(*parts: Column | str | int) -> Column:
    """First eight bytes of the SHA-256 of the parts joined by colons, in hex (an unsigned 64-bit seed does not fit a long)."""
    made = [x if isinstance(x, Column) else F.lit(str(x)) for x in parts]
    return F.substring(F.sha2(F.concat_ws(":", *made), 256), 1, 16)


def seed_number(hexed: Column | str) -> Column:
    return F.conv(_c(hexed), 16, 10).cast("decimal(20,0)")


def pair_hash(pair: Column | str) -> Column:
    return F.sha2(_c(pair).cast("string"), 256)


def in_second_half(pair: Column | str) -> Column:
    """True where the first 32 bits of the hash are odd: the second validation half."""
    return F.conv(F.substring(pair_hash(pair), 1, 8), 16, 10).cast("long") % 2 == 1


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it: a plan would write it out at each place."""
    return F.element_at(F.transform(F.array(value), use), 1)


# ---------------------------------------------------------------- sentences

#: Abbreviations whose full stop ends no sentence, matched as bare substrings, in this order.
ABBREVIATIONS = ("e.g.", "i.e.", "al.", "Fig.", "et al.", "vs.", "Dr.", "Prof.", "approx.", "dept.", "no.", "ca.", "c.a.", "viz.")
#: Bullet signs.
BULLETS = "•●○▪▶►✓✔"
#: List marks, repairs before the cut in order, and where sentences are cut.
_ITEM = r"(?:[0-9ivx]+\.|\([0-9ivxa-z]+\)|[0-9ivxa-z]+\))"

REPAIRS = (
    (r"([a-z0-9])\.([A-Z])", "$1. $2"),
    (rf"(?<=[^\s.:;])\s*([{BULLETS}])\s*", ". $1 "),
    (rf"([{BULLETS}])\s*", "$1 "),
    (rf"([;:])\s*({_ITEM})\s*([A-Za-z])", "$1 $2 $3"),
    (r"\b([a-zA-Z]{3,})-\s+([a-zA-Z]{3,})\b", "$1$2"),
)
CUT = rf"(?<=[.!?])\s+(?=[A-Z0-9\"'({BULLETS}\-])|(?<=[^\s])\s*(?=[{BULLETS}])|(?<=[;:])\s+(?={_ITEM}\s+[A-Z])"


def segment_sentences(text: Column | str) -> Column:
    """Sentences of a text; none for blank text, else at least one.

    Abbreviations are hidden, missing spaces and bullets are normalised, words parted at a line end are
    joined, and the text is cut after a stop before a capital, before bullets and before list marks.
    """
    hide = [(a, f"{chr(0xE100 + k)}") for k, a in enumerate(ABBREVIATIONS)]

    def shown(part: Column) -> Column:
        plainly = part
        for plain, hidden in hide:
            plainly = F.replace(plainly, F.lit(hidden), F.lit(plain))
        return F.when(part.rlike(f"[{hide[0][1]}-{hide[-1][1]}]"), plainly).otherwise(part)  # few sentences have one

    def cut(whole: Column) -> Column:
        out = whole
        for plain, hidden in hide:
            out = F.replace(out, F.lit(plain), F.lit(hidden))
        for pattern, to in REPAIRS:
            out = F.regexp_replace(out, pattern, to)
        bare = F.transform(F.split(out, CUT, -1), lambda part: F.regexp_replace(part, r"^\s+|\s+$", ""))
        found = F.filter(F.transform(bare, shown), lambda s: (s != "") & (s != "."))
        some = once(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(whole)))
        return F.when(whole == "", F.array().cast("array<string>")).otherwise(some)

    return once(F.regexp_replace(_c(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), cut)


def chunk_sentence(sentence: Column | str, max_tokens: int = 300, count: object = None) -> Column:
    """Greedy chunks of at most max_tokens tokens, cut at clauses, and inside a clause at words.

    count gives the tokens of a string column (default: words at spaces). A blank sentence has no
    chunk; a single word over the limit is an error.
    """
    count = count or (lambda s: F.size(space_tokens(s)))
    whole = _c(sentence)
    joined = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit(" "), b))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc: Column, piece: Column) -> Column:
        longer = joined(acc["now"], piece)
        fits = count(longer) <= max_tokens
        kept = F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
        return F.when(fits, F.struct(acc["done"].alias("done"), longer.alias("now"))).otherwise(F.struct(kept.alias("done"), piece.alias("now")))

    clauses = F.split(whole, r"(?<=[;,])\s+|(?<=[^\s])\s+(?=\([0-9ivx]+\)\s+[A-Za-z])")
    pieces = F.flatten(F.transform(clauses, lambda c: F.when(count(c) <= max_tokens, F.array(c)).otherwise(space_tokens(c))))
    safe = F.transform(pieces, lambda p: F.when(count(p) <= max_tokens, p).otherwise(F.raise_error(F.lit("a single token span is over the limit"))))
    end = F.aggregate(safe, state, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.array_append(s["done"], s["now"])))
    return F.when(normalize_text(whole) == "", F.array().cast("array<string>")).when(count(whole) <= max_tokens, F.array(whole)).otherwise(end)


# ---------------------------------------------------------------- translation screens


def char_ngrams(text: Column | str, n: int) -> Column:
    """Character n-grams of a text without its white space."""
    bare = without_space(text)
    return F.when(F.length(bare) >= n, F.transform(F.sequence(F.lit(1), F.length(bare) - n + 1), lambda i: F.substr(bare, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def truncated(alignment: Column | str, min_source: int = 80, ratio: float = 0.4) -> Column:
    """Some aligned source sentence of over min_source characters keeps under ratio of them."""
    return F.exists(_c(alignment), lambda p: (F.length(p["en"]) > min_source) & (F.length(p["tr"]) < F.lit(ratio) * F.length(p["en"])))


def translation_issues(source: Column | str, target: Column | str) -> Column:
    """Names of the failed checks: empty, identical (whatever the case), length_ratio outside 0.35 to 3, control characters."""
    en, tr = F.coalesce(_c(source), F.lit("")), F.coalesce(_c(target), F.lit(""))
    ends = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
    bare = F.regexp_replace(tr, ends, "")
    ratio = F.length(tr).cast("double") / F.greatest(F.lit(1), F.length(en))
    checks = F.array(
        F.when(F.lower(F.regexp_replace(en, ends, "")) == F.lower(bare), "identical"),
        F.when((ratio < 0.35) | (ratio > 3.0), "length_ratio"),
        F.when(tr.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "control_characters"),
    )
    return F.when(bare == "", F.array(F.lit("empty"))).otherwise(F.filter(checks, lambda x: x.isNotNull()))


def label_questions(template: str, name: Column | str) -> Column:
    """A template with its one {name} field filled in."""
    if template.count("{name}") != 1:
        raise ValueError("the template needs one {name} field")
    return F.replace(F.lit(template), F.lit("{name}"), _c(name))


def primary_language(counts: Column | str, min_words: int = 2, min_share: float = 0.2) -> Column:
    """Language of a map language -> letter words, `und` below min_words, `a-b` where two languages both have
    min_words words and min_share of all."""
    m = _c(counts)
    total = F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)
    strong = F.array_sort(F.filter(F.map_keys(m), lambda k: (F.element_at(m, k) >= min_words) & (F.element_at(m, k) >= F.lit(min_share) * total)))
    best = F.array_max(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("k"))))
    return F.when(F.coalesce(total, F.lit(0)) < min_words, "und").when(F.size(strong) >= 2, F.array_join(F.slice(strong, 1, 2), "-")).otherwise(best["k"])
