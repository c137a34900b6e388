"""Problem 2: text extracted from scanned pages, repaired into continuous paragraphs.

Three statistics over all records come first: how often each word occurs, which beginnings and ends of lines occur
almost only at page edges, and which edge lines recur (fuzzily, on several pages) within one file. Then each record is worked on alone:

1. lines that carry a page number are found by their style and by their values, which go up with the pages;
2. lines at the page edges those numbers mark are running headers or footers if they resemble a line that recurs at the
   edges of the file's pages, or begin or end as such lines do;
3. a line that ends in a hyphen is joined with the next running line, by the vocabulary either as one word or as a compound
   that keeps its hyphen;
4. a word that is rare, but turns into a frequent word when a known misreading is undone, is misread.

Defined results: null and blank contents have no lines to report and come out as they are; records of other types pass
unchanged; rows without a file are a file of their own; ties between repairs go to the more frequent word, then the first
in order; an end-of-line hyphen without a next running line stays.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.session import materialise, scratch_path
from ragmill.sources.shared import parquet_files, row_groups_with

PDF = "application/pdf"
# What a scanner reads instead of what is printed, as (seen, printed).
MISREADINGS = [
    ("c", "e"), ("o", "a"), ("f", "t"), ("ii", "u"), ("cl", "d"), ("rn", "m"), ("b", "h"), ("vv", "w"), ("h", "li"),
    ("rm", "nn"), ("m", "rn"), ("d", "cl"), ("t", "l"), ("e", "c"), ("a", "o"), ("e", "o"), ("u", "ii"), ("li", "h"), ("l", "i"), ("i", "l"), ("tl", "d"), ("n", "ri"), ("ri", "n"),
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("9", "g"), ("2", "z"), ("8", "b"),
]
#: The same by the first letter seen.
BY_LETTER = {letter: [m for m in MISREADINGS if m[0][0] == letter] for letter in {m[0][0] for m in MISREADINGS}}
HYPHENS = "-\u2010\u00ad\u00ac"
#: A hyphen of these kinds is only ever put at a line's end by the typesetting.
SOFT = "\u00ad\u00ac"
#: Words of at least this share of all words, which are at most a million, go to every task; the counts of the others, from this
#: many on, are read where they are asked for.
KNOWN_SHARE, KNOWN_LEAST = 1e-6, 4
#: Files that the counts of rare words are cut into, and rows of their row groups.
RARE_BUCKETS, RARE_TOGETHER = 64, 5_000
#: Bits that stand for the beginnings of rare words, and as many for those of long ones.
START_BITS = 1 << 24
#: How many times more frequent than the word as seen its repair must be.
RATIO = 20
#: A beginning or end of lines marks headers and footers if this share of at least so many such lines lie at page edges.
EDGE_SHARE, EDGE_LEAST = 0.9, 8
#: Share of a file's pages that a line at their edges recurs on. In large files so many pages are enough for lines that never
#: end like a sentence, such as the headers of a chapter.
FILE_SHARE, FEW_PAGES = 0.02, 8
#: Lines of more letters are compared by their longest common subsequence, and don't travel with every page of a file.
LONG_LINE = 120
#: Lines at either end of a page that may be furniture.
EDGE_LINES = 2
#: Words from this length on are looked at for misreadings; longer ones than the second have bits of their own, which stay few.
SHORTEST, LONG_WORD = 3, 48
WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_SENTENCE_ENDS = (".", ",", ";", ":", "!", "?", "-", "\u2010")
_ENDS = ".,;:!?()\"'-"
_GOES_ON = re.compile("[" + HYPHENS + r"][^\S\n]*\n\s*([^\W_]+)")
_CUT = re.compile("[" + HYPHENS + r"][^\S\n]*\n\s*[^\W_]*")
_FIRST = re.compile(r"\s*([^\W\d_]{3,})\s+\d")
_LAST = re.compile(r"[^\W\d_]{4,}")
COMPOUND = re.compile(r"[^\W\d_]+(?:[-‐][^\W\d_]+)+")
#: Lines that carry a page number, by style; the first group is the number.
STYLES = [
    ("dash", re.compile(r"[-–—]{1,3}\s*(\d{1,5})\s*[-–—]{1,3}")),
    ("dash-of", re.compile(r"[-–—]{1,3}\s*(\d{1,5})\s+of\s+\d{1,5}\s*[-–—]{1,3}", re.I)),
    ("bracket", re.compile(r"[\[(<{|]\s*(\d{1,5})\s*[\])>}|]")),
    ("page-of", re.compile(r"(?:page|pg\.?|p\.)\s*(\d{1,5})\s*(?:of|/)\s*\d{1,5}\.?", re.I)),
    ("page", re.compile(r"(?:page|pg\.?|p\.)\s*(\d{1,5})\.?", re.I)),
    ("of", re.compile(r"(\d{1,5})\s*(?:of|/)\s*\d{1,5}", re.I)),
    ("bar", re.compile(r"(\d{1,5})\s*\|\s*\S.*")),
    ("bar-end", re.compile(r"\S.*\|\s*(\d{1,5})")),
    ("title", re.compile(r"[^\W\d].*\s{3,}(\d{1,5})")),
    ("number", re.compile(r"(\d{1,5})")),
    ("roman", re.compile(r"(?:(?:page|pg\.?|p\.)\s*|[-–—]{1,3}\s*|[\[(]\s*)?([ivxl]{1,8}|[IVXL]{1,8})(?:\s*[-–—]{1,3}|\s*[\])])?")),
]
#: Styles that a line of a table or of text may have too.
WEAK = {"number", "roman", "title", "of", "bar", "bar-end"}


def page_number(line: str) -> tuple[str, int] | None:
    text = line.strip()
    if not text or (len(text) > 40 and not text[0].isdigit() and not text[-1].isdigit()):
        return None
    if not _DIGIT.search(text):
        m = STYLES[-1][1].fullmatch(text) if len(text) < 16 else None
        value = _roman(m.group(1).lower()) if m else 0
        return ("roman", value) if value else None
    for style, pattern in STYLES[:-1]:
        if m := pattern.fullmatch(text):
            return style, int(m.group(1))
    return None


def _roman(text: str) -> int:
    """The value of a small lower-case Roman numeral, 0 for anything else."""
    value = {"i": 1, "v": 5, "x": 10, "l": 50}
    digits = [value[c] for c in text]
    total = sum(-d if d < max(digits[i:]) else d for i, d in enumerate(digits))
    tens, ones = divmod(total, 10)
    written = ("", "x", "xx", "xxx", "xl", "l")[tens] if 0 <= tens < 6 else "?"
    return total if written + ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[ones] == text else 0


def plain(line: str) -> str:
    """A line's letters, the same for all pages and for most misreadings of one character."""
    return re.sub(r"[\W\d_]+", " ", line).strip().lower()


def alike(a: str, b: str, least: float = 0.8) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < least * max(len(a), len(b)) or len(a) < 4:
        return False
    if max(len(a), len(b)) > LONG_LINE:
        return 2 * in_common(a, b) >= least * (len(a) + len(b))
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.quick_ratio() >= least and m.ratio() >= least


def in_common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by the bits of one number."""
    same = len(os.path.commonprefix((a, b)))
    a, b = a[same:], b[same:]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    free = every
    for c in b:
        met = free & places.get(c, 0)
        free = ((free + met) | (free - met)) & every
    return same + len(a) - free.bit_count()


def numbered(lines: list[str], whole: bool, page: int | None) -> dict[int, int]:
    """line -> number, of the lines that carry this record's page numbers."""
    visible = [i for i, l in enumerate(lines) if l.strip()]
    if not visible:
        return {}
    found: dict[str, list[tuple[int, int]]] = {}
    for i in visible:
        if n := page_number(lines[i]):
            found.setdefault(n[0], []).append((i, n[1]))
    edge = set(visible[:EDGE_LINES] + visible[-EDGE_LINES:])
    out: dict[int, int] = {}
    for style, hits in found.items():
        if whole and style in WEAK:
            chain = _rising(hits, 8)
            if len(chain) > 1:
                out.update(chain)
                continue
        if style in WEAK:
            # One page: the outermost line, or the number the record's page has.
            for i, n in hits:
                if page is not None and n == page:
                    if i in edge:
                        out[i] = n
                elif i == visible[0] or (i == visible[-1] and not _cell(lines[visible[-2]])):
                    out[i] = n
        else:
            out.update({i: n for i, n in hits if whole or i in edge})
    return out


def _cell(line: str) -> bool:
    """Whether a line may be a cell of a table."""
    text = line.strip()
    return len(text) < 16 and not text.endswith((".", "!", "?")) and not text[:1].islower()


def _rising(hits: list[tuple[int, int]], apart: int) -> list[tuple[int, int]]:
    """The longest run of hits whose numbers go up by one, or a few where numbers between were misread, at least so many lines
    apart for each."""
    best: list[tuple[int, int]] = []
    ends: dict[int, list[tuple[int, int]]] = {}
    for i, n in hits:
        run = [(i, n)]
        for step in (1, 2, 3):
            before = ends.get(n - step)
            if before and i - before[-1][0] >= apart * step:
                run = [*before, (i, n)]
                break
        if n not in ends or len(run) >= len(ends[n]):
            ends[n] = run
        if len(run) > len(best):
            best = run
    return best


def page_edges(lines: list[str], numbers: dict[int, int], whole: bool) -> list[tuple[int, int]]:
    """(line, page of the record) of the lines that may be headers or footers: next to the record's ends and its numbers."""
    visible = [i for i, l in enumerate(lines) if l.strip() and i not in numbers]
    marks = sorted(numbers) if whole else []
    out: list[tuple[int, int]] = []
    at = 0
    for page, mark in enumerate([*marks, len(lines)]):
        here = []
        while at < len(visible) and visible[at] < mark:
            here.append(visible[at])
            at += 1
        near = dict.fromkeys(here[:EDGE_LINES] + here[-EDGE_LINES:])
        out += [(i, page) for i in near]
    return out


@dataclass
class Corpus:
    """What is known of all records: word counts, joined and hyphenated, and how lines at page edges begin and end."""

    words: dict[str, int]
    compounds: dict[str, int]
    #: Words that lines at page edges end in, and that start such lines before a number.
    last: frozenset[str]
    first: frozenset[str]
    #: Counts of words and compounds that don't go to every task, if there are any.
    rare: RareWords | None = None
    repaired: dict[str, str | None] = field(default_factory=dict)
    #: The known words in order, made when first asked for.
    ordered: list[str] = field(default_factory=list)
    #: What was read of the rare ones: counts of words and of compounds, and the words and cut words they were read for.
    seldom: tuple[dict[str, int], dict[str, int]] = field(default_factory=lambda: ({}, {}))
    learned: set = field(default_factory=set)
    #: ``last`` and ``first``, made ready for near matches when first asked for.
    forms: tuple[Forms, Forms] | None = None

    #: Words remembered.
    MOST = 300_000

    def count(self, word: str) -> int:
        return self.words.get(word) or self.seldom[0].get(word, 0)

    def compound_count(self, word: str) -> int:
        return self.compounds.get(word) or self.seldom[1].get(word, 0)

    def learn(self, contents: list[str]) -> None:
        """Read the counts that these records may ask for: of their words that are not known, of words and compounds that a line's
        end cuts, and of what undoing misreadings makes of them. A word with a repair that every task knows needs none."""
        if self.rare is None:
            return
        if len(self.learned) > self.MOST:
            self.learned, self.seldom, self.repaired, self._sorted = set(), ({}, {}), {}, (0, [])
        forms, cut = set(), set()
        for content in contents:
            forms.update(self._unknown(content))
            for m in _GOES_ON.finditer(content):
                if first := _word_before(content, m.start()):
                    cut.add((first.lower(), m.group(1).lower()))
        cut -= self.learned
        for first, rest in cut:
            forms.update((first, rest, first + rest))
        forms -= self.learned
        forms -= self.words.keys()
        if forms:
            self.seldom[0].update(self.rare.counts("w", forms))
            made = set()
            for word in forms:
                own = self.seldom[0].get(word, 0)
                if self._best(word, own) is None:
                    begins = self.rare.may_begin_long if len(word) > LONG_WORD else self.rare.may_begin
                    for edits in (1,) if own else (1, 2):
                        made.update(w for w in self._undone(word, 0, "", edits, begins) if begins(w))
            self.seldom[0].update(self.rare.counts("w", made - self.words.keys()))
            self.learned |= forms
        if cut:
            sides = {w: {w, self._repair(w) or w} for pair in cut for w in pair}
            compounds = {f"{a}-{b}" for first, rest in cut for a in sides[first] for b in sides[rest]}
            self.seldom[1].update(self.rare.counts("c", compounds - self.compounds.keys()))
            self.learned |= cut

    def _unknown(self, content: str) -> set[str]:
        # Words are cut at white space first: most pieces are plain known words.
        pieces = {p.strip(_ENDS) for p in set(content.lower().split())} - self.words.keys()
        return {w for p in pieces for w in WORD.findall(p)}

    def _best(self, word: str, own: int) -> str | None:
        """The repair among the words that every task has; there is none better, as the others are rarer."""
        least = max(RATIO * max(own, 0.05), own + 1, KNOWN_LEAST)
        for edits in (1, 2) if not own else (1,):
            found = [(-n, new) for new in self._undone(word, 0, "", edits) if (n := self.words.get(new, 0)) >= least and new.isalpha()]
            if found:
                return min(found)[1]
        return None

    def repair(self, word: str) -> str | None:
        """The frequent word that this one is a misreading of, in its case, or None."""
        if word in self.repaired:
            return self.repaired[word]
        found = self._repair(word.lower()) if SHORTEST <= len(word) and sum(map(str.isalpha, word)) * 2 > len(word) else None
        if found and word[:1].isupper():
            found = found.upper() if word.isupper() and len(word) > 1 else found[:1].upper() + found[1:]
        if len(self.repaired) > 500_000:
            self.repaired.clear()
        self.repaired[word] = found
        return found

    def _repair(self, word: str) -> str | None:
        own = self.count(word)
        least = max(RATIO * max(own, 0.05), own + 1, KNOWN_LEAST)
        best: tuple[int, str] | None = None
        for edits in (1, 2) if not own else (1,):
            # Two misreadings, the second behind the first, only where one explains nothing.
            for new in self._undone(word, 0, "", edits):
                n = self.count(new)
                if n >= least and (best is None or (-n, new) < best) and new.isalpha():
                    best = (-n, new)
            if best:
                return best[1]
        return None

    def _undone(self, word: str, at: int, made: str, edits: int, begins: Callable[[str], bool] | None = None) -> Iterator[str]:
        """Each word that undoing ``edits`` misreadings from ``at`` on gives, ``made`` being the text before. Ways that no known
        word, or none that ``begins`` tells of, begins with are left at once, which loses nothing and makes long words cheap."""
        begins = begins or self._begins
        while at < len(word):
            for read, printed in BY_LETTER.get(word[at], ()):
                if word.startswith(read, at):
                    new, on = made + printed, at + len(read)
                    if edits == 1:
                        yield new + word[on:]
                    elif begins(new):
                        yield from self._undone(word, on, new, edits - 1, begins)
            made += word[at]
            at += 1
            if not begins(made):
                return

    def _begins(self, start: str) -> bool:
        """Whether a known word begins so."""
        if not self.ordered:
            self.ordered = sorted(self.words)
        for words in (self.ordered, self._seldom_ordered()):
            i = bisect_left(words, start)
            if i < len(words) and words[i].startswith(start):
                return True
        return False

    def _seldom_ordered(self) -> list[str]:
        if self._sorted[0] != len(self.seldom[0]):
            self._sorted = len(self.seldom[0]), sorted(self.seldom[0])
        return self._sorted[1]

    _sorted = 0, []


class RareWords:
    """Counts of words in files on the shared file system, by bucket and sorted; only row groups that may hold a word asked for
    are read. ``starts`` has a bit for the hash of every beginning of these words, which spares most questions."""

    def __init__(self, path: str, starts: np.ndarray):
        self.path, self.starts = path, starts

    def may_begin(self, start: str) -> bool:
        """False only if no word here begins so."""
        at = zlib.crc32(start.encode("utf-8", "surrogatepass")) & START_BITS - 1
        return bool(self.starts[at >> 3] >> (at & 7) & 1)

    def may_begin_long(self, start: str) -> bool:
        """False only if no word here begins so that a word of more than ``LONG_WORD`` letters may be a misreading of."""
        at = START_BITS + (zlib.crc32(start.encode("utf-8", "surrogatepass")) & START_BITS - 1)
        return bool(self.starts[at >> 3] >> (at & 7) & 1)

    def counts(self, kind: str, wanted: set[str]) -> dict[str, int]:
        buckets: dict[int, list[str]] = {}
        for word in wanted:
            buckets.setdefault(zlib.crc32(word.encode("utf-8", "surrogatepass")) % RARE_BUCKETS, []).append(word)
        out: dict[str, int] = {}
        for bucket, inside in buckets.items():
            inside.sort()
            for file in parquet_files([f"{self.path}/bucket={bucket}"]):
                for group in row_groups_with(file, "word", inside):
                    rows = file.read_row_group(group, columns=["kind", "word", "n"]).to_pydict()
                    out.update((w, n) for k, w, n in zip(rows["kind"], rows["word"], rows["n"]) if k == kind and w in wanted)
        return out

    @classmethod
    def written(cls, counts: DataFrame) -> RareWords:
        """``counts`` is (kind, word, n)."""
        path = scratch_path(counts.sparkSession, "rare-words")
        rows = counts.select("kind", F.translate("word", "‐", "-").alias("word"), "n").groupBy("kind", "word").agg(F.sum("n").alias("n"))
        rows = rows.withColumn("bucket", (F.crc32("word") % RARE_BUCKETS).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "word")
        rows.write.option("parquet.block.row.count.limit", RARE_TOGETHER).partitionBy("bucket").parquet(path)

        def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(START_BITS >> 2, np.uint8)
            for batch in batches:
                for word in batch.column(0).to_pylist():
                    sum_ = 0
                    for c in word:
                        sum_ = zlib.crc32(c.encode("utf-8", "surrogatepass"), sum_)
                        at = sum_ & START_BITS - 1
                        bits[at >> 3] |= 1 << (at & 7)
                        if len(word) > LONG_WORD - 2:  # two misreadings make a word longer by two letters at most
                            at += START_BITS
                            bits[at >> 3] |= 1 << (at & 7)
            yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

        # Of few tasks, one array of 4 MB each.
        parts = counts.sparkSession.read.parquet(path).where("kind = 'w'").select("word").coalesce(16).mapInArrow(beginnings, "bits binary").toArrow()
        starts = np.zeros(START_BITS >> 2, np.uint8)
        for part in parts.column("bits").to_pylist():
            starts |= np.frombuffer(part, np.uint8)
        return cls(path, starts)


def _word_before(text: str, end: int) -> str:
    """The letters and digits that end there."""
    at = end
    while at and text[at - 1].isalnum():
        at -= 1
    return text[at:end]


def _tail(line: str) -> tuple[str, str] | None:
    """(first part of a word, its hyphen) at a line's end."""
    line = line.rstrip()
    if line[-1:] not in HYPHENS or not line:
        return None
    first = _word_before(line, len(line) - 1)
    return (first, line[-1]) if first else None


def _head(line: str) -> str:
    m = re.match(r"\s*([^\W_]+)", line)
    return m.group(1) if m else ""


def hyphenation(corpus: Corpus, first: str, hyphen: str, rest: str) -> tuple[str, str | None] | None:
    """How a word goes on: ('split', its misreading's repair or None), ('compound', None), or None where nothing goes on."""
    if not rest or not (rest[0].islower() or rest[0].isdigit() or first.isupper()):
        return None
    whole = (first + rest).lower()
    joined = corpus.count(whole)
    kept = corpus.compound_count(f"{first}-{rest}".lower())
    if hyphen in SOFT:
        return "split", None if joined else corpus.repair(first + rest)
    if kept > joined:
        return "compound", None
    if joined:
        return "split", corpus.repair(first + rest)
    fixed = corpus.repair(first + rest)
    if fixed:
        return "split", fixed
    sides = [corpus.repair(w) or w for w in (first, rest)]
    if corpus.compound_count("-".join(sides).lower()):
        return "compound", None
    if all(corpus.count(w.lower()) for w in sides) and len(first) > 1:
        return "compound", None
    return "split", None


@dataclass
class Page:
    """What was found in one record."""

    lines: list[str]
    furniture: set[int]
    split: dict[int, tuple[int, str]]  # line -> (line it goes on in, the word as it should be)
    compound: dict[int, int]
    misread: set[int]


def read(content: str, page: int | None, known: list[str], corpus: Corpus, few: FewLines | None = None) -> Page:
    lines = content.split("\n")
    whole = page is None
    numbers = numbered(lines, whole, page)
    furniture = set(numbers)
    edges = page_edges(lines, numbers, whole)
    own = Counter()
    for i, p in edges:
        own[plain(lines[i])] += 1
    for i, _ in edges:
        key = plain(lines[i])
        if not key:
            continue
        repeats = any(alike(key, k) for k in known) or (few is not None and few.has(key)) or (whole and any(n > 1 and alike(key, k) for k, n in own.items()))
        if repeats or _edge_line(lines[i], corpus):
            furniture.add(i)
    if whole:
        # Pages whose number got lost: their headers stand amid the record.
        titles = {plain(lines[i]) for i in furniture - set(numbers)} | set(known)
        for i, line in enumerate(lines):
            if i not in furniture and line.strip():
                first, last = line_form(line)
                if last in corpus.last or (first in corpus.first and ":" in line) or (len(line) > 8 and ((key := plain(line)) in titles or (few is not None and len(key) > LONG_LINE and key in few.lines))):
                    furniture.add(i)
    running = [i for i, l in enumerate(lines) if l.strip() and i not in furniture]
    out = Page(lines, furniture, {}, {}, set())
    skip_first: set[int] = set()
    for i, j in zip(running, running[1:]):
        tail = _tail(lines[i])
        if not tail:
            continue
        rest = _head(lines[j])
        how = hyphenation(corpus, *tail, rest)
        if not how:
            continue
        if how[0] == "compound":
            out.compound[i] = j
            continue
        word = how[1] or tail[0] + rest
        out.split[i] = (j, word)
        skip_first.add(j)
        if how[1]:
            # The misread letters are where the word as seen and its repair part.
            seen, fixed = (tail[0] + rest).lower(), how[1].lower()
            at = next((n for n, (a, b) in enumerate(zip(seen, fixed)) if a != b), min(len(seen), len(fixed)))
            out.misread.add(i if at < len(tail[0]) else j)
    for i in running:
        words = WORD.findall(lines[i])
        if i in skip_first:
            words = words[1:]
        if i in out.split:
            words = words[:-1]
        repaired = corpus.repaired
        for w in words:
            if (repaired[w] if w in repaired else corpus.repair(w)) is not None:
                out.misread.add(i)
                break
    return out


def _near(a: str, b: str) -> bool:
    """Equal but for one character."""
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= (len(b) > 4)


def line_form(line: str) -> tuple[str | None, str | None]:
    """(the word a line starts with before a number, the word it ends in without any stop)."""
    first = _FIRST.match(line)
    end = line.rstrip()
    last = None
    if end and end[-1].isalpha():
        words = _LAST.findall(end, max(0, len(end) - 60))
        if words and end.endswith(words[-1]) and words[-1].isalpha():
            last = words[-1].lower()
    return first.group(1).lower() if first else None, last


class Forms:
    """Words that lines begin or end with, found by length and by either half, as one character may be misread in the other."""

    def __init__(self, words: frozenset[str]):
        self.lengths: dict[int, tuple[set[str], dict[str, list[str]], dict[str, list[str]]]] = {}
        for word in words:
            whole, left, right = self.lengths.setdefault(len(word), (set(), {}, {}))
            whole.add(word)
            left.setdefault(word[: len(word) // 2], []).append(word)
            right.setdefault(word[len(word) // 2 :], []).append(word)

    def near(self, text: str) -> bool:
        if len(text) not in self.lengths:
            return False
        whole, left, right = self.lengths[len(text)]
        if text in whole:
            return True
        half = len(text) // 2
        return any(_near(text, w) for w in left.get(text[:half], ())) or any(_near(text, w) for w in right.get(text[half:], ()))


def _edge_line(line: str, corpus: Corpus) -> bool:
    """Whether a line begins or ends as lines at page edges do, perhaps with one character misread."""
    text = line.strip().lower()
    if corpus.forms is None:
        corpus.forms = Forms(corpus.last), Forms(corpus.first)
    last, first = corpus.forms
    if any(last.near(text[-n:]) for n in last.lengths):
        return True
    return any(first.near(text[:n]) and re.match(r".{0,3}[\d:]", text[n:]) for n in first.lengths)


def repaired_text(page: Page, corpus: Corpus) -> str:
    """The record's running text: one line per paragraph, words whole and repaired."""
    lines, paragraphs, current = page.lines, [], ""
    skip: dict[int, int] = {}
    widths = sorted(len(l.rstrip()) for i, l in enumerate(lines) if l.strip() and i not in page.furniture)
    usual = widths[len(widths) // 2] if widths else 0

    def fix(text: str) -> str:
        return WORD.sub(lambda m: corpus.repair(m.group()) or m.group(), text)

    pending = ""
    previous: int | None = None
    blank = False
    for i, line in enumerate(lines):
        if i in page.furniture:
            continue
        if not line.strip():
            blank = True
            continue
        text = line.strip()
        if i in skip:
            text = text[skip[i] :].lstrip() if text[skip[i] : skip[i] + 1].isspace() else text[skip[i] :]
        hyphened = previous is not None and (previous in page.split or previous in page.compound)
        indented = line[:1].isspace() and len(line) - len(line.lstrip()) >= 2 and previous is not None and not lines[previous][:1].isspace()
        short = previous is not None and len(lines[previous].rstrip()) < 0.6 * usual
        if not hyphened and previous is not None and ((blank and _ended(current)) or indented or (short and (_ended(current) or len(text) < 0.6 * usual))):
            paragraphs.append(current)
            current = ""
        if i in page.split:
            j, word = page.split[i]
            cut = re.search(r"[^\W_]+[" + HYPHENS + r"]\s*$", text)
            head = _head(lines[j])
            skip[j] = len(head)
            text, pending = fix(text[: cut.start()]), word
        elif i in page.compound:
            text, pending = fix(text.rstrip()[:-1]), "-"
        else:
            text, pending = fix(text), ""
        if hyphened or not current:
            current += text
        else:
            current += " " + text
        current += pending
        previous, blank = i, False
    if current:
        paragraphs.append(current)
    return "\n".join(p for p in paragraphs if p.strip())


def _ended(text: str) -> bool:
    return text.rstrip("\"'”’)]").endswith((".", "!", "?", ":", "…")) or not text


# -- statistics over all records ----------------------------------------------------------------------------------------


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def without_cut_words(text: str) -> str:
    """The text without words that a line's end may cut."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        start = m.start()
        while start > at and text[start - 1].isalnum():
            start -= 1
        out.append(text[at:start])
        at = max(at, m.end())
    out.append(text[at:])
    return "\n".join(out)


def word_counts(rows: DataFrame) -> DataFrame:
    """(kind, word, n, edge): words (kind w) and hyphenated compounds (c) of all records, and the forms of PDF records' lines
    (f, l: their first and last words) with how many of them are at page edges. Counted in the tasks first; words cut by a
    line's end are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, compounds, forms, edge = Counter(), Counter(), Counter(), Counter()

        def flush():
            out = [("w", w, n, 0) for w, n in words.items()] + [("c", w, n, 0) for w, n in compounds.items()]
            out += [(*form, n, edge.get(form, 0)) for form, n in forms.items()]
            for c in (words, compounds, forms, edge):
                c.clear()
            for i in range(0, len(out), 200_000):
                yield _batch(out[i : i + 200_000], ["kind", "word", "n", "edge"], [pa.string(), pa.string(), pa.int64(), pa.int64()])

        for batch in batches:
            for content, pdf, page in zip(*(c.to_pylist() for c in batch.columns)):
                if not content:
                    continue
                text = without_cut_words(content.lower())
                words.update(WORD.findall(text))
                for token in text.split():
                    if "-" in token or "‐" in token:
                        compounds.update(COMPOUND.findall(token))
                if pdf:
                    lines = content.split("\n")
                    numbers = numbered(lines, page is None, page)
                    edges = {i for i, _ in page_edges(lines, numbers, page is None)}
                    for i, line in enumerate(lines):
                        if i not in numbers:
                            found = [x for x in zip("fl", line_form(line)) if x[1]]
                            forms.update(found)
                            if i in edges:
                                edge.update(found)
            if len(words) + len(compounds) + len(forms) > 1_000_000:
                yield from flush()
        yield from flush()

    counted = rows.select("content", "pdf", "page").mapInArrow(run, "kind string, word string, n bigint, edge bigint")
    return counted.groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("edge").alias("edge"))


def corpus_of(rows: DataFrame) -> Corpus:
    counts = materialise(word_counts(rows), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # Words from a share of 1e-6 on are at most a million, whatever the corpus.
    bar = max(KNOWN_LEAST, KNOWN_SHARE * total)
    # Forms of lines: only those used, each at least so many times at page edges.
    form = F.col("kind").isin(*"fl") & (F.col("edge") >= EDGE_LEAST) & (F.col("edge") >= EDGE_SHARE * F.col("n"))
    kept = counts.where(form | (F.col("kind").isin("w", "c") & (F.col("n") >= bar))).select("kind", "word", "n").toArrow().to_pydict()
    others = counts.where((F.col("n") < bar) & (F.col("n") >= KNOWN_LEAST) & F.col("kind").isin("w", "c"))
    rare = RareWords.written(others) if bar > KNOWN_LEAST else None
    words, compounds, forms = {}, {}, {"f": set(), "l": set()}
    for kind, word, n in zip(kept["kind"], kept["word"], kept["n"]):
        if kind in forms:
            forms[kind].add(word)
        else:
            table, word = words if kind == "w" else compounds, word.replace("‐", "-")
            table[word] = table.get(word, 0) + n
    return Corpus(words, compounds, frozenset(forms["l"]), frozenset(forms["f"]), rare)


class FewLines:
    """Lines of a file that are looked up: found if equal or alike.

    Lines of lengths a and b with m letters in common, in order, have at most 1 + a + b - 2m stretches in common, so at least
    3m - 1 - a - b pairs of letters; alike ones, with 2m >= 0.8 (a + b), at least 0.2 (a + b) - 1. Only those are compared."""

    def __init__(self, lines: list[str]):
        self.lines = set(lines)
        self.ordered = sorted(self.lines, key=len)
        self.lengths = np.fromiter(map(len, self.ordered), np.int64, len(self.ordered))
        found: dict[tuple[str, int], list[int]] = {}
        for i, line in enumerate(self.ordered):
            for pair in self._pairs(line):
                found.setdefault(pair, []).append(i)
        self.by_pair = {pair: np.array(at, np.int32) for pair, at in found.items()}

    @staticmethod
    def _pairs(line: str) -> set[tuple[str, int]]:
        """The pairs of letters, numbered where one occurs again."""
        seen: dict[str, int] = {}
        out = set()
        for pair in map("".join, zip(line, line[1:])):
            seen[pair] = n = seen.get(pair, 0) + 1
            out.add((pair, n))
        return out

    def has(self, key: str) -> bool:
        if key in self.lines:
            return True
        n = len(key)
        low, high = np.searchsorted(self.lengths, (int(0.8 * n), int(n / 0.8) + 2))
        if low == high:
            return False
        shared = np.zeros(high - low, np.int32)
        for pair in self._pairs(key):
            if (at := self.by_pair.get(pair)) is not None:
                first, end = np.searchsorted(at, (low, high))
                shared[at[first:end] - low] += 1
        near = np.flatnonzero(shared >= 0.2 * (n + self.lengths[low:high]) - 1 - 1e-6)
        return any(alike(key, self.ordered[low + i]) for i in near[np.argsort(-shared[near], kind="stable")])


class FileLines:
    """``FewLines`` by file, read from the shared file system when a file first comes up."""

    #: Files and lines held, besides one file.
    MOST, MOST_LINES = 64, 100_000

    def __init__(self, path: str):
        self.path, self.held = path, {}

    def of(self, file: str) -> FewLines | None:
        if file not in self.held:
            if len(self.held) >= self.MOST or sum(len(few.lines) for few in self.held.values() if few) > self.MOST_LINES:
                self.held.clear()
            lines = []
            bucket = zlib.crc32(file.encode()) % RARE_BUCKETS
            for part in parquet_files([f"{self.path}/bucket={bucket}"]):
                for group in row_groups_with(part, "file", [file]):
                    rows = part.read_row_group(group, columns=["file", "line"]).to_pydict()
                    lines += [line for f, line in zip(rows["file"], rows["line"]) if f == file]
            self.held[file] = FewLines(lines) if lines else None
        return self.held[file]

    @classmethod
    def written(cls, lines: DataFrame) -> FileLines | None:
        """``lines`` is (file, line); None if there are none."""
        path = scratch_path(lines.sparkSession, "few-lines")
        rows = lines.withColumn("bucket", (F.crc32("file") % RARE_BUCKETS).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "file")
        rows.write.option("parquet.block.row.count.limit", RARE_TOGETHER).partitionBy("bucket").parquet(path)
        return None if lines.sparkSession.read.schema("file string").parquet(path).isEmpty() else cls(path)


def file_furniture(rows: DataFrame) -> tuple[DataFrame, FileLines | None]:
    """(file, known, few): the edge lines that recur under different page numbers and on at least ``FILE_SHARE`` of a file's
    pages, which bounds them by 4 / FILE_SHARE a file; and long ones and those that recur on fewer pages of large files, to be
    looked up where a file has some (few). Counted per line before the lines of a file come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, content, page in zip(*(c.to_pylist() for c in batch.columns)):
                lines, seen = content.split("\n"), set()
                for i, p in page_edges(lines, numbered(lines, page is None, page), page is None):
                    number = page if page is not None else -1 - p
                    if p not in seen:
                        seen.add(p)
                        out.append((file, "", number, False))
                    if text := plain(lines[i]):
                        out.append((file, text, number, lines[i].rstrip().endswith(_SENTENCE_ENDS)))
            yield _batch(out, ["file", "line", "page", "stop"], [batch.schema.field(0).type, pa.string(), pa.int32(), pa.bool_()])

    kind = rows.schema["file"].dataType.simpleString()
    edges = rows.where("pdf and content is not null").select("file", "content", "page").mapInArrow(run, f"file {kind}, line string, page int, stop boolean")
    counts = F.count(F.lit(1)).alias("n"), F.min("page").alias("first"), F.max("page").alias("last"), F.max("stop").alias("stop")
    lines = edges.groupBy("file", "line").agg(*counts)
    lines = materialise(lines.where("line = '' or first <> last"), "edge-lines")
    pages = lines.where("line = ''").select("file", F.col("n").alias("pages"))
    both = lines.where("line <> ''").join(pages, "file")
    often = F.col("n") >= F.col("pages") * FILE_SHARE
    short = F.length("line") <= LONG_LINE
    few = (often & ~short) | (~often & ~F.col("stop") & (F.col("n") >= FEW_PAGES))
    known = both.groupBy("file").agg(F.sort_array(F.collect_list(F.when(often & short, F.col("line")))).alias("known"), F.max(few).alias("few"))
    return known.where("few or size(known) > 0"), FileLines.written(both.where(few).select("file", "line"))


def pdf_rows(records: DataFrame, key: str) -> DataFrame:
    """(key, file, content, page, pdf) of handler records."""
    pdf = F.coalesce(F.lower(F.col("metadata.mimeType")) == PDF, F.lit(False))
    file = F.coalesce(F.concat(F.lit("f"), F.col("file_no")), F.concat(F.lit("r"), F.col(key)))
    return records.select(F.col(key).alias("key"), file.alias("file"), "content", F.col("metadata.page").alias("page"), pdf.alias("pdf"))


def _read_all(rows: DataFrame, work, schema: str) -> DataFrame:
    corpus = rows.sparkSession.sparkContext.broadcast(corpus_of(rows))
    known, few = file_furniture(rows)
    known = materialise(known, "furniture")
    pages = rows.where("pdf").join(known, "file", "left").select("key", "content", "page", "known", F.when(F.col("few"), F.col("file")).alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                corpus.value.learn([c for c in part.column(1).to_pylist() if c])
                rows_ = zip(*(c.to_pylist() for c in part.columns))
                yield work(part.schema.field(0).type, rows_, corpus.value, few)

    return pages.mapInArrow(run, schema)


def found_lines(records: DataFrame, key: str) -> DataFrame:
    """(key, line_no, kind): furniture, split and misread lines of PDF records, numbered from 1."""
    rows = pdf_rows(records, key)

    def work(kind: pa.DataType, rows_, corpus: Corpus, few: FileLines | None) -> pa.RecordBatch:
        out = []
        for k, content, page, known, file in rows_:
            if not content or content.isspace():
                continue
            found = read(content, page, known or [], corpus, few and file and few.of(file))
            for name, lines in (("furniture", found.furniture), ("split", found.split), ("misread", found.misread)):
                out += [(k, i + 1, name) for i in sorted(lines)]
        return _batch(out, ["key", "line_no", "kind"], [kind, pa.int32(), pa.string()])

    return _read_all(rows, work, f"key {rows.schema['key'].dataType.simpleString()}, line_no int, kind string")


def paragraphs(records: DataFrame, key: str) -> DataFrame:
    """(key, text): every record; the text of PDF records as continuous paragraphs, other contents as they are."""
    rows = pdf_rows(records, key)

    def work(kind: pa.DataType, rows_, corpus: Corpus, few: FileLines | None) -> pa.RecordBatch:
        out = []
        for k, content, page, known, file in rows_:
            blank = not content or content.isspace()
            out.append((k, content if blank else repaired_text(read(content, page, known or [], corpus, few and file and few.of(file)), corpus)))
        return _batch(out, ["key", "text"], [kind, pa.string()])

    done = _read_all(rows, work, f"key {rows.schema['key'].dataType.simpleString()}, text string")
    return done.unionByName(rows.where("not pdf").select("key", F.col("content").alias("text")))
