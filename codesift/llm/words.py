"""Hashes of words, for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once; longer texts are cut at white space.
SLICE = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; equal values stay equal, others stay different."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLD) + np.uint64(salt)) | np.uint64(1)


def _bytes(fold: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    if fold:
        table[65:91] += np.uint64(32)
    return mix((table + np.uint64(1)) * np.uint64(_GOLD))


_LOWER, _EXACT = _bytes(True), _bytes(False)
# Kinds of bytes: lower case, upper case, digit, each ASCII mark by itself, the rest as letters.
_KIND = np.arange(256, dtype=np.uint64)
_KIND[97:123] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48
_KIND[128:] = 97


def slices(text: str) -> Iterator[bytes]:
    """The UTF-8 bytes of a text in pieces that end at white space."""
    data = text.encode("utf-8", "surrogatepass")
    begin = 0
    while len(data) - begin > SLICE:
        end = begin + SLICE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[begin:end]
        begin = end
    yield data[begin:]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of words, and for every byte whether it is white space."""
    space = _SPACE[data]
    before = np.empty_like(space)
    before[:1], before[1:] = True, space[:-1]
    return np.flatnonzero(before & ~space), space


def _hash(data: np.ndarray, starts: np.ndarray, space: np.ndarray, table: np.ndarray = _LOWER) -> np.ndarray:
    """One value per word, of its bytes and their places; A-Z as a-z unless another table is given."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = starts[0]
    data, space, starts = data[first:], space[first:], starts - first
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(starts, np.diff(starts, append=len(data))).astype(np.uint64)
    parts = mix(table[data] + place * np.uint64(_GOLD))
    parts[space] = 0
    return mix(np.add.reduceat(parts, starts))


def _shapes(data: np.ndarray, starts: np.ndarray, space: np.ndarray) -> np.ndarray:
    """One value per word, of its runs of equal kinds of characters ("Then," is upper, lower, comma)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = starts[0]
    kind, space, starts = _KIND[data[first:]], space[first:], starts - first
    new = np.empty(len(kind), bool)
    new[0], new[1:] = True, kind[1:] != kind[:-1]
    new &= ~space
    runs = np.cumsum(new)
    place = (runs - np.repeat(runs[starts], np.diff(starts, append=len(kind)))).astype(np.uint64)
    parts = mix(kind + (place + np.uint64(1)) * np.uint64(_GOLD))
    parts[~new] = 0
    return mix(np.add.reduceat(parts, starts))


def batches(texts: list[str]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Pieces of joined texts of about SLICE bytes: numbers of the first text and after the last, bytes, offsets of texts.

    A longer text comes alone, in several pieces.
    """
    held: list[bytes] = []
    size, first = 0, 0
    for i, text in enumerate(texts):
        if len(text) > SLICE // 4:
            if held:
                yield first, i, b"\n".join(held), np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
            for piece in slices(text):
                yield i, i + 1, piece, np.zeros(1, np.int64)
            held, size, first = [], 0, i + 1
            continue
        held.append(text.encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        if size > SLICE:
            yield first, i + 1, b"\n".join(held), np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
            held, size, first = [], 0, i + 1
    if held:
        yield first, len(texts), b"\n".join(held), np.cumsum([0] + [len(x) + 1 for x in held[:-1]])


def word_hashes(texts: list[str], shapes: bool = False, fold: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Hashes of all words of all texts in order (A-Z as a-z if ``fold``), their shapes if wanted, and the number of words of each text."""
    counts = np.zeros(len(texts), np.int64)
    hashes, forms = [], []
    for first, after, piece, offsets in batches(texts):
        data = np.frombuffer(piece, np.uint8)
        starts, space = _words(data)
        hashes.append(_hash(data, starts, space, _LOWER if fold else _EXACT))
        if shapes:
            forms.append(_shapes(data, starts, space))
        counts[first:after] += np.diff(np.searchsorted(starts, offsets), append=len(starts))
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(hashes or empty), np.concatenate(forms or empty) if shapes else None, counts
