"""Words of texts as numbers: the multiset tokens and hashed minima that the near-duplicate operators share.

A word is a run of letters and digits of the lower-cased text. The i-th occurrence of a word is a token of its own, so the
similarity of two texts - words in common over words in either, repeats counting - is the Jaccard similarity of token sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

WORD = re.compile(r"[^\W_]+")
#: Texts are worked on in slices of about this many characters, which bounds a task's memory whatever a text's length.
SLICE_CHARS = 4_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    MOST = 1_000_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE_CHARS`` together; a longer text stands alone."""
    start = chars = 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > SLICE_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def multiset(texts: list[str], salts: np.ndarray, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, row of each token, tokens per row); rows in order, a salt per row keeps groups of rows apart."""
    words: list[str] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        found = WORD.findall(text.lower())
        counts[i] = len(found)
        words += found
    base = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    row = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((base, row))
    base = base[order]
    if len(base):
        new = np.empty(len(base), dtype=bool)
        new[0] = True
        new[1:] = (base[1:] != base[:-1]) | (row[1:] != row[:-1])
        at = np.arange(len(base))
        repeat = at - np.maximum.accumulate(np.where(new, at, 0))
        with np.errstate(over="ignore"):
            base = mix(base + repeat.astype(np.uint64) * GOLDEN + salts[row])
    return base, row, counts


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed pseudo-random constants of ``n`` hash orders."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1), mix(np.arange(n + 1, 2 * n + 1, dtype=np.uint64) * GOLDEN)


def minima(tokens: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(rows, n): each row's first token under each of ``n`` global orders; every row has a token."""
    a, b = multipliers(n)
    out = np.empty((len(starts), n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out[:, j] = np.minimum.reduceat((tokens ^ b[j]) * a[j], starts)
    return out


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def parity(tokens: np.ndarray, row: np.ndarray, rows: int, bits: int = 512) -> np.ndarray:
    """(rows, bits/64) int64: per row the parity of its tokens in each of ``bits`` classes. Two rows' parities differ in no
    more places than their token sets do, so their XOR bounds the distance from below."""
    flips = np.bincount(row * bits + (tokens & np.uint64(bits - 1)).astype(np.int64), minlength=rows * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(rows, bits), axis=1).view(np.int64)


def similarity(a: str, b: str) -> float:
    """Words in common over words in either, repeats counting; texts without words are alike only if equal."""
    from collections import Counter

    x, y = Counter(WORD.findall(a.lower())), Counter(WORD.findall(b.lower()))
    total = x.total() + y.total()
    if not total:
        return 1.0 if a == b else 0.0
    common = sum(min(n, y[w]) for w, n in x.items() if w in y)
    return common / (total - common)
