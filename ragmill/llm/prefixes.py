"""Prefixes of texts under global token orders, as sorted labels: what the near-duplicate operators find candidates with.

A tree is one global order of all tokens. A text's prefix in a tree is its first tokens in that order, and the label spells the
prefix out, some bits per token, so that texts that share their first d tokens share the first d parts of the label and stand
next to each other when labels are sorted. Two texts of similarity s share their first d tokens with a probability of about
s**d (exactly C(common, d) / C(union, d)), in each tree anew; ``depths`` says how long a prefix may be for a text's size.

Entries (label, key, size, sketch) travel as packed arrays, one per bucket, a bucket being a hash of the first three tokens.
The sketch holds two bits of the first token of 48 orders; texts that are near enough differ in more than ``MOST_APART`` of
them with a probability of 3e-5. Which pairs meet is found by binary search in the sorted entries of a bucket.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ragmill.llm import words

#: Similarity from which on texts are near.
THRESHOLD = 0.75
#: Tokens that decide about the bucket; no prefix is shorter.
HEAD = 3
#: Orders in a sketch, and how many of them may disagree: 20 of 48 are 4 deviations more than the 9 expected at the threshold.
SKETCHED, MOST_APART = 48, 20
#: Sizes up to this one fit into an entry; larger ones count as of this size when sizes are compared.
MOST_SIZE = (1 << 16) - 1
#: A group of entries with one prefix that has more members is compared in blocks, by other tasks.
BLOCK = 4_096
#: Pairs that are looked at together.
AT_ONCE = 2_000_000

_NARROW = np.dtype([("hi", "<u4"), ("lo", "<u2"), ("key", "<u4"), ("n", "<u2"), ("s", "<u8"), ("t", "<u4"), ("fp", "<u2")])
_WIDE = np.dtype([("hi", "<u4"), ("lo", "<u2"), ("key", "<i8"), ("n", "<u2"), ("s", "<u8"), ("t", "<u4"), ("fp", "<u2")])
_LAST = np.uint32(0xFFFFFFFF)


def first_tokens(tokens: np.ndarray, counts: np.ndarray, orders: int, k: int) -> np.ndarray:
    """(rows, orders, k): each row's first k tokens under each order, as their places in the order, ascending; rows with fewer
    tokens are filled up with the last place. ``tokens`` are 32-bit numbers, row after row, ``counts`` of them each."""
    with np.errstate(over="ignore"):
        multiply = (words.mix(np.arange(1, orders + 1, dtype=np.uint64) * words.GOLDEN) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        flip = (words.mix(np.arange(orders + 1, 2 * orders + 1, dtype=np.uint64) * words.GOLDEN) >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(counts), orders, k), _LAST)
    starts = np.cumsum(counts) - counts
    by_size = np.argsort(counts, kind="stable")
    at = int(np.searchsorted(counts[by_size], 1))
    while at < len(by_size):
        # Rows of about one size as a matrix that stays in the processor's cache.
        rows = by_size[at : at + max(1, 65_536 // max(k, int(counts[by_size[at]])))]
        limit = max(k, int(counts[rows[0]]) * 5 // 4)
        rows = rows[counts[rows] <= limit]
        at += len(rows)
        width = max(k, int(counts[rows[-1]]))
        place = np.arange(width)
        beyond = place[None, :] >= counts[rows][:, None]
        matrix = tokens[np.minimum(starts[rows][:, None] + place, len(tokens) - 1)]
        pad = np.where(beyond, _LAST, np.uint32(0))
        found = np.empty((len(rows), orders, k), dtype=np.uint32)
        for j in range(orders):
            ordered = np.maximum((matrix ^ flip[j]) * multiply[j], pad)
            if width > k:
                ordered.partition(k - 1, axis=1)
            found[:, j] = ordered[:, :k]
        out[rows] = found
    out.sort(axis=2)
    return out


@functools.lru_cache(maxsize=8)
def depths(trees: int, deepest: int, miss: float, threshold: float = THRESHOLD) -> np.ndarray:
    """By the larger size of two texts: the longest prefix that two texts at the threshold share in some tree but for a
    probability of ``miss``. 0 stands for sizes where near texts are equal, the last value for all larger sizes."""
    out = np.zeros(2_048, dtype=np.int8)
    for n in range(HEAD, len(out)):
        unions = range(n, min(n + 40, int(2 * n / (1 + threshold) + 1e-9)) + 1)  # of two texts the larger of which has n tokens
        for d in range(deepest, HEAD - 1, -1):
            least = 1.0
            for union in unions:
                common = math.ceil(threshold * union - 1e-9)
                least = min(least, math.prod((common - i) / (union - i) for i in range(d)) if common >= d else 0.0)
            if (1 - least) ** trees <= miss or d == HEAD:
                out[n] = d
                break
    return np.minimum.accumulate(out[::-1])[::-1]


@dataclass(frozen=True)
class Forest:
    """How many trees there are, how long their labels, and the probability that a near pair shares no prefix."""

    trees: int
    deepest: int
    miss: float
    threshold: float = THRESHOLD

    @property
    def bits(self) -> int:
        return 48 // self.deepest

    def depth(self, n: np.ndarray) -> np.ndarray:
        table = depths(self.trees, self.deepest, self.miss, self.threshold)
        return table[np.minimum(n, len(table) - 1)]

    def labels(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(labels, hashes of the first three tokens, sketch, rest of the sketch); the first two have a column per tree."""
        first = first_tokens((tokens >> np.uint64(32)).astype(np.uint32), counts, max(self.trees, SKETCHED), self.deepest)
        with np.errstate(over="ignore"):
            place = np.arange(first.shape[1], dtype=np.uint64) << np.uint64(32)
            named = words.mix((first.astype(np.uint64) | place[None, :, None]) * words.GOLDEN)
            low = named[:, :SKETCHED, 0] & np.uint64(3)
            s = (low[:, :32] << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)
            t = (low[:, 32:] << (np.arange(16, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).astype(np.uint32)
            named = named[:, : self.trees]
            head = np.zeros(named.shape[:2], dtype=np.uint64)
            for d in range(HEAD):
                head = words.mix(head * words.GOLDEN + named[:, :, d])
            label = np.zeros(named.shape[:2], dtype=np.uint64)
            for d in range(self.deepest):
                label = (label << np.uint64(self.bits)) | (named[:, :, d] >> np.uint64(64 - self.bits))
        return label, head, s, t


def packed(label: np.ndarray, key: np.ndarray, n: np.ndarray, s: np.ndarray, t: np.ndarray, fp: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, base, entries) of each bucket that has any; keys are stored as distances from a base where they are close."""
    if not len(label):
        return
    base = int(key.min())
    close = int(key.max()) - base < 1 << 32
    order = np.argsort(bucket, kind="stable")
    out = np.empty(len(order), dtype=_NARROW if close else _WIDE)
    label, key = label[order], key[order]
    out["hi"], out["lo"] = (label >> np.uint64(16)).astype(np.uint32), (label & np.uint64(0xFFFF)).astype(np.uint16)
    out["key"] = (key - base).astype(np.uint32) if close else key
    out["n"], out["s"], out["t"], out["fp"] = n[order], s[order], t[order], fp[order]
    bucket = bucket[order]
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[i]), base if close else NO_BASE, out[i:j].tobytes()


#: Stands for entries that hold their keys themselves.
NO_BASE = -(1 << 63)


class Entries:
    """Unpacked entries, sorted by label and size; of equal ones the one with the smallest key stays."""

    def __init__(self, label, key, n, s, t, fp, unique: bool = True):
        with np.errstate(over="ignore"):
            order = np.argsort((label << np.uint64(16)) | n.astype(np.uint64), kind="stable")
        parts = [x[order] for x in (label, key, n, s, t, fp)]
        if unique and len(order) > 1:
            label, key, n, s, t, fp = parts
            same = (label[1:] == label[:-1]) & (n[1:] == n[:-1])
            touched = np.flatnonzero(np.append(False, same) | np.append(same, False))
            if len(touched):
                inner = np.lexsort((key[touched], fp[touched], t[touched], s[touched], n[touched], label[touched]))
                parts = [np.array(x) for x in parts]
                for x in parts:
                    x[touched] = x[touched][inner]
                label, key, n, s, t, fp = parts
                equal = (label[1:] == label[:-1]) & (n[1:] == n[:-1]) & (s[1:] == s[:-1]) & (t[1:] == t[:-1]) & (fp[1:] == fp[:-1])
                parts = [x[np.append(True, ~equal)] for x in parts]
        self.label, self.key, self.n, self.s, self.t, self.fp = parts

    def __len__(self) -> int:
        return len(self.label)

    def take(self, at) -> Entries:
        out = object.__new__(Entries)
        out.label, out.key, out.n, out.s, out.t, out.fp = (x[at] for x in (self.label, self.key, self.n, self.s, self.t, self.fp))
        return out

    def blob(self) -> tuple[int, bytes]:
        """(base, packed entries)."""
        return next((base, x) for _, base, x in packed(self.label, self.key, self.n, self.s, self.t, self.fp, np.zeros(len(self), np.int32)))


def fields_of(bases: list[int], blobs: list) -> tuple[np.ndarray, ...]:
    """(label, key, n, s, t, fp) of packed entries."""
    parts = []
    for base, blob in zip(bases, blobs):
        x = np.frombuffer(blob, dtype=_WIDE if base == NO_BASE else _NARROW)
        label = (x["hi"].astype(np.uint64) << np.uint64(16)) | x["lo"].astype(np.uint64)
        key = x["key"].astype(np.int64) + (0 if base == NO_BASE else base)
        parts.append((label, key, x["n"], x["s"], x["t"], x["fp"]))
    if not parts:
        return tuple(np.zeros(0, dtype=d) for d in (np.uint64, np.int64, np.uint16, np.uint64, np.uint32, np.uint16))
    return tuple(np.concatenate(p) for p in zip(*parts))


def unpacked(bases: list[int], blobs: list, unique: bool = True) -> Entries:
    return Entries(*fields_of(bases, blobs), unique=unique)


#: The lower bit of every two.
_ODD = np.uint64(0x5555555555555555)


def sketches_near(a: Entries, i: np.ndarray, b: Entries, j: np.ndarray) -> np.ndarray:
    """Which pairs of entries' sketches disagree in no more orders than texts that are near."""
    x, y = a.s[i] ^ b.s[j], (a.t[i] ^ b.t[j]).astype(np.uint64)
    apart = np.bitwise_count((x | (x >> np.uint64(1))) & _ODD) + np.bitwise_count((y | (y >> np.uint64(1))) & _ODD)
    return apart <= MOST_APART


def runs(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with first[i] <= j < last[i], some at a time."""
    many = np.maximum(last - first, 0)
    ends = np.cumsum(many)
    at, done = 0, 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
        n = many[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
        if len(i):
            yield i, j
        done, at = int(ends[to - 1]), to


def _largest_partner(n: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(np.floor(n.astype(np.float64) / threshold + 1e-6), MOST_SIZE).astype(np.uint64)


def self_pairs(entries: Entries, forest: Forest, hot: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, keys) of entries with equal prefixes, near in size and sketch. Two texts meet at the prefix that is long enough
    for the larger one. Groups larger than ``BLOCK`` are cut up and put into ``hot``, if given, as (entries, entries) blobs."""
    small, large = forest.depth(entries.n), forest.depth(_largest_partner(entries.n, forest.threshold).astype(np.int64))
    for d in sorted({int(x) for x in np.unique(small)} - {0}, reverse=True):
        at = np.flatnonzero((small <= d) & (large >= d) & (small > 0))
        group = entries.label[at] >> np.uint64(forest.bits * (forest.deepest - d))
        if d < forest.deepest:
            order = np.argsort((group << np.uint64(16)) | entries.n[at].astype(np.uint64), kind="stable")
            at, group = at[order], group[order]
        place = (group << np.uint64(16)) | entries.n[at].astype(np.uint64)
        last = np.searchsorted(place, (group << np.uint64(16)) | _largest_partner(entries.n[at], forest.threshold), side="right")
        first = np.arange(1, len(at) + 1)
        if hot is not None:
            cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else [], len(group)).astype(np.int64)
            for x, y in zip(cuts[:-1], cuts[1:]):
                if y - x > BLOCK:
                    first[x:y] = last[x:y]
                    blocks = [entries.take(at[z : min(z + BLOCK, y)]) for z in range(x, y, BLOCK)]
                    for p, one in enumerate(blocks):
                        for two in blocks[p:]:
                            if int(two.n.min()) <= int(_largest_partner(one.n.max(keepdims=True), forest.threshold)[0]):
                                hot.append((d, one.blob(), two.blob()))
        for i, j in runs(first, last):
            i, j = at[i], at[j]
            ok = (small[j] == d) & (entries.key[i] != entries.key[j])
            i, j = i[ok], j[ok]
            ok = sketches_near(entries, i, entries, j)
            yield entries.key[i[ok]], entries.key[j[ok]]


def block_pairs(d: int, one: tuple[int, bytes], two: tuple[int, bytes], forest: Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of two blocks of one hot group."""
    a, b = (unpacked([x[0]], [x[1]], unique=False) for x in (one, two))
    a, b = (e.take(np.argsort(e.n, kind="stable")) for e in (a, b))
    first = np.arange(1, len(a) + 1) if one == two else np.searchsorted(b.n, np.ceil(a.n * forest.threshold - 1e-6))
    last = np.searchsorted(b.n, _largest_partner(a.n, forest.threshold), side="right")
    for i, j in runs(first, last):
        ok = (np.maximum(forest.depth(a.n[i]), forest.depth(b.n[j])) == d) & (a.key[i] != b.key[j])
        i, j = i[ok], j[ok]
        ok = sketches_near(a, i, b, j)
        yield a.key[i[ok]], b.key[j[ok]]


def cross_pairs(asked: Entries, held: Entries, forest: Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys asked, keys held) of entries with equal prefixes, near in size and sketch: a range search in ``held``, which is
    sorted by label, for each entry asked; its prefix is widened from the whole label down to what its size needs."""
    if not len(asked) or not len(held):
        return
    own = forest.depth(asked.n)
    most = forest.depth(_largest_partner(asked.n, forest.threshold).astype(np.int64))
    for d in sorted({int(x) for x in np.unique(np.concatenate([own, most]))} - {0}, reverse=True):
        at = np.flatnonzero((own <= d) & (most >= d) & (own > 0))
        shift = np.uint64(forest.bits * (forest.deepest - d))
        low = (asked.label[at] >> shift) << shift
        first, last = np.searchsorted(held.label, low), np.searchsorted(held.label, low + (np.uint64(1) << shift))
        for i, j in runs(first, last):
            i = at[i]
            x, y = asked.n[i].astype(np.int64), held.n[j].astype(np.int64)
            ok = (np.minimum(x, y) >= np.maximum(x, y) * forest.threshold - 1e-6) & (forest.depth(np.maximum(x, y)) == d)
            i, j = i[ok], j[ok]
            ok = sketches_near(asked, i, held, j)
            yield asked.key[i[ok]], held.key[j[ok]]


def distinct_pairs(parts) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, the smaller key first, in order."""
    low, high = [], []
    for x, y in parts:
        if len(x):
            low.append(np.minimum(x, y))
            high.append(np.maximum(x, y))
            if sum(map(len, low)) > 4_000_000:
                one, two = unique_pairs(np.concatenate(low), np.concatenate(high))
                low, high = [one], [two]
    if not low:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return unique_pairs(np.concatenate(low), np.concatenate(high))


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return a[keep], b[keep]


def integer_key(schema, key: str) -> str:
    """The type of a key column, which has to be a whole number."""
    kind = schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be a column of whole numbers, not {kind}")
    return kind


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))
