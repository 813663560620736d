"""MD5 of many short texts at once, in NumPy: texts that are a number and one of a few endings."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
#: Longest text of one MD5 block.
_BLOCK = 55
#: Texts hashed at once: the working arrays stay in a core's cache.
_AT_ONCE = 32_768


def md5_heads(numbers: np.ndarray, endings: Sequence[str]) -> np.ndarray:
    """The first six hex digits, as a number, of the MD5 of each number with each ending: an array (numbers, endings)."""
    tails = [e.encode() for e in endings]
    out = np.empty((len(numbers), len(tails)), np.uint32)
    if not out.size:
        return out
    text = np.char.encode(np.asarray(numbers).astype(str))
    width = np.char.str_len(text)
    for d in np.unique(width).tolist():
        own = np.flatnonzero(width == d)
        short = np.array([d + len(t) <= _BLOCK for t in tails])
        if short.any():
            out[np.ix_(own, np.flatnonzero(short))] = _heads(text[own].astype(f"S{d}"), d, [t for t, s in zip(tails, short, strict=True) if s])
        for j in np.flatnonzero(~short).tolist():
            out[own, j] = [int(hashlib.md5(x + tails[j], usedforsecurity=False).hexdigest()[:6], 16) for x in text[own].tolist()]
    return out


def _heads(text: np.ndarray, d: int, tails: list[bytes]) -> np.ndarray:
    """One block a text: words that hold digits differ by row, the others by ending only."""
    ends = np.zeros((len(tails), 64), np.uint8)
    for j, t in enumerate(tails):
        ends[j, d : d + len(t)] = np.frombuffer(t, np.uint8)
        ends[j, d + len(t)] = 0x80
        ends[j, 56:58] = np.frombuffer((8 * (d + len(t))).to_bytes(2, "little"), np.uint8)
    ends = np.ascontiguousarray(ends.view("<u4").T)
    front = np.zeros((len(text), 64), np.uint8)
    front[:, :d] = np.ascontiguousarray(text).view(np.uint8).reshape(len(text), d)
    front = front.view("<u4")
    out = np.empty((len(text), len(tails)), np.uint32)
    step = max(1, _AT_ONCE // len(tails))
    for lo in range(0, len(text), step):
        out[lo : lo + step] = _first_bytes(front[lo : lo + step], ends, (d + 3) // 4)
    return out


def _first_bytes(front: np.ndarray, ends: np.ndarray, varied: int) -> np.ndarray:
    shape = (len(front), ends.shape[1])
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    a, b, c, e = (np.full(shape, x, np.uint32) for x in _START)
    words = [front[:, i : i + 1] | ends[i] if i < varied else ends[i] for i in range(16)]
    for i in range(61):  # the word that opens the digest is last set in step 60
        turn, k = divmod(i, 16)
        if turn == 0:
            np.bitwise_xor(c, e, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, e, out=f)
            w = k
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, e, out=f)
            np.bitwise_xor(f, c, out=f)
            w = (5 * k + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, e, out=f)
            w = (3 * k + 5) % 16
        else:
            np.invert(e, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            w = 7 * k % 16
        np.add(a, f, out=a)
        if w < varied:
            np.add(a, words[w], out=a)
            np.add(a, _SINES[i], out=a)
        else:
            np.add(a, words[w] + _SINES[i], out=a)
        s = _SHIFTS[turn][k % 4]
        np.right_shift(a, np.uint32(32 - s), out=g)
        np.left_shift(a, np.uint32(s), out=a)
        np.bitwise_or(a, g, out=a)
        np.add(a, b, out=a)
        a, b, c, e = e, a, b, c
    np.add(b, _START[0], out=b)
    return (b & np.uint32(0xFF)) << np.uint32(16) | b & np.uint32(0xFF00) | b >> np.uint32(16) & np.uint32(0xFF)
