"""Seeded typing noise (Arrow): one random stream a text, so draws depend on those before them.

A strategy is a table row: where it may act, what it does there, and what it does when chance changed
nothing. Seeds come from the record's id, strategy and severity, so reruns and partitionings agree.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named severities, Turkish letters without their marks, punctuation that trades places.
SEVERITIES = {"light": 0.05, "medium": 0.10}
ASCII_OF = {"ç": "c", "Ç": "C", "ğ": "g", "Ğ": "G", "ı": "i", "İ": "I", "ö": "o", "Ö": "O", "ş": "s", "Ş": "S", "ü": "u", "Ü": "U"}
TRADES = {".": ",", ",": ".", "!": "?", "?": "!", ";": ":", ":": ";"}


def severity_of(severity: str | float) -> float:
    """The edit probability: a named severity, or a number over 0 up to 1."""
    if isinstance(severity, bool) or not isinstance(severity, str | int | float):
        raise TypeError("severity is a name or a number")
    p = SEVERITIES.get(severity) if isinstance(severity, str) else float(severity)
    if p is None or not 0 < p <= 1:
        raise ValueError(f"unknown severity {severity!r}")
    return p


def seed_of(record_id: str, strategy: str, severity: str | float, base_seed: int = 42) -> int:
    return int(hashlib.sha256(f"{record_id}:{strategy}:{severity}:{base_seed}".encode()).hexdigest()[:16], 16)


def _toggled(c: str) -> str:
    return c.lower() if c.isupper() else c.upper()


@dataclass(frozen=True)
class PerSign:
    """Acts on single signs: applies() chooses them, becomes() replaces one."""

    applies: Callable[[str], bool]
    becomes: Callable[[str], str]
    otherwise: Callable[[str, random.Random], str]

    def __call__(self, text: str, p: float, draw: random.Random) -> str:
        spots = [i for i, c in enumerate(text) if self.applies(c)]
        chosen = {i for i in spots if draw.random() < p}
        out = "".join(self.becomes(c) if i in chosen else c for i, c in enumerate(text))
        if out != text:
            return out
        if not spots:
            return self.otherwise(text, draw)
        at = draw.choice(spots)
        return text[:at] + self.becomes(text[at]) + text[at + 1 :]


def _doubled(text: str, draw: random.Random | None = None) -> str:
    """Every letter and digit twice; without any, the last sign once more."""
    return "".join(c * 2 if c.isalnum() else c for c in text) if any(map(str.isalnum, text)) else text + text[-1:]


def swap(text: str, p: float, draw: random.Random) -> str:
    """Trades two unlike neighbours inside words at spaces."""
    parts = text.split(" ")
    spots = [[j for j in range(len(w) - 1) if w[j] != w[j + 1]] for w in parts]

    def traded(k: int) -> str:
        j, w = draw.choice(spots[k]), parts[k]
        return w[:j] + w[j + 1] + w[j] + w[j + 2 :]

    out = [traded(k) if spots[k] and draw.random() < p else w for k, w in enumerate(parts)]
    if out == parts:
        able = [k for k, s in enumerate(spots) if s]
        if not able:
            return _doubled(text)
        k = draw.choice(able)
        out[k] = traded(k)
    return " ".join(out)


def delete(text: str, p: float, draw: random.Random) -> str:
    """Drops letters and digits; never all of a text."""
    spots = [i for i, c in enumerate(text) if c.isalnum()]
    gone = {i for i in spots if draw.random() < p}
    if not gone:
        if len(spots) == 1:
            return _doubled(text)
        gone = {draw.choice(spots)} if spots else set()
    return "".join(c for i, c in enumerate(text) if i not in gone).strip() or text


def widen(text: str, p: float, draw: random.Random) -> str:
    """Second spaces after words; a single word is parted in the middle."""
    first, *rest = text.split(" ")
    if not rest:
        return f"{text[: len(text) // 2]} {text[len(text) // 2 :]}" if len(text) > 1 else _doubled(text)
    gaps = [" " if draw.random() >= p else "  " for _ in rest]
    if all(g == " " for g in gaps):
        gaps[0] = "  "
    return first + "".join(g + w for g, w in zip(gaps, rest, strict=True))


duplicate = PerSign(str.isalnum, lambda c: c * 2, lambda text, draw: text + text[-1:])
toggle = PerSign(str.isalpha, _toggled, _doubled)
punctuate = PerSign(TRADES.__contains__, TRADES.__getitem__, lambda text, draw: text + ".")
plain_letters = PerSign(ASCII_OF.__contains__, ASCII_OF.__getitem__, lambda text, draw: swap(text, 0.1, draw))


def combined(text: str, p: float, draw: random.Random) -> str:
    """A typing slip (swap 35 %, double 35 %, drop 30 %), then at chance p each case and punctuation noise."""
    roll = draw.random()
    out = (swap if roll < 0.35 else duplicate if roll < 0.70 else delete)(text, p, draw)
    for noise, share in ((toggle, 0.05), (punctuate, 0.10)):
        if draw.random() < p:
            out = noise(out, share, draw)
    return out if out != text else _doubled(text)


STRATEGIES: dict[str, Callable[[str, float, random.Random], str]] = {
    "char_swap": swap, "char_delete": delete, "char_duplicate": duplicate, "whitespace": widen,
    "capitalization": toggle, "punctuation": punctuate, "turkish_diacritics": plain_letters, "combined": combined,
}


def perturbed(text: str, record_id: str, strategy: str = "combined", severity: str | float = "medium", seed: int = 42, language: str = "en") -> str:
    """A text with at least one edit that survives trimming."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "turkish_diacritics" and language != "tr":
        raise ValueError("turkish_diacritics is for Turkish text")
    if not text or not text.strip():
        raise ValueError("blank text")
    out = STRATEGIES[strategy](text, severity_of(severity), random.Random(seed_of(record_id, strategy, severity, seed))).strip()
    clean = text.strip()
    return out if out and out != clean else _doubled(clean)


def perturb(text: Column | str, record_id: Column | str, strategy: str = "combined", severity: str | float = "medium", seed: int = 42, language: str = "en") -> Column:
    """perturbed() of each row; null and blank texts give null."""
    severity_of(severity)
    if strategy not in STRATEGIES or (strategy == "turkish_diacritics" and language != "tr"):
        raise ValueError(f"strategy {strategy!r} does not suit {language!r}")

    @F.pandas_udf("string")
    def noisy(texts: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([perturbed(t, str(i), strategy, severity, seed, language) if isinstance(t, str) and t.strip() else None for t, i in zip(texts, ids, strict=True)])

    return noisy(text, record_id)


def perturb_native(text: Column | str, record_id: Column | str, p: float = 0.1, seed: int = 42) -> Column:
    """Letter-doubling without Python: a sign is doubled where a hash of its place falls under p; SQL can repeat it."""
    t = F.col(text) if isinstance(text, str) else text
    i = F.col(record_id).cast("string") if isinstance(record_id, str) else record_id.cast("string")
    signs = F.split(t, "")
    hit = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", i, k.cast("string"), F.lit(str(seed)))), 1, 6), 16, 10).cast("long") < int(p * (1 << 24))
    return F.array_join(F.transform(signs, lambda c, k: F.when(c.rlike("[A-Za-z0-9]") & hit(k), F.concat(c, c)).otherwise(c)), "")
