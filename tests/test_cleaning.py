import random
import re

import pytest
from pyspark.sql import functions as F

from ragmill.functions import text as T

GOLDEN = [
    ("Intro line\nPage 3 of 10\nnext line.", "Intro line next line."),
    ("Year\n2024\nRevenue", "Year Revenue"),
    ("Body text.\n\n-- 1 of 2 --\n\n", "Body text."),
    ("- 12 -\nText.", "Text."),
    ("1.2 Intro ..... 7\nBody.", "1.2 Intro Body."),
    ("1 x ... 1 ... 2", "1 x"),
    ("This line has leader dots ...... and more\nkeep.", "keep."),
    ("Confidentiality clause here\nkept.", "kept."),
    ("abc\n\ndef", "abc def"),
    ("abc.\ndef", "abc.def"),
    ("a.\n\n\n\nb", "a. b"),
    ("Same line.\nSame line.\nOther.", "Same line.Other."),
    ("say hi!\nhi! there", "say hi! there"),
    ("a.\r\nb", "a.\r b"),
    ("  ﻿x \n", "x"),
    ("", ""),
    (None, ""),
]


def column(spark, values, stage):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.select("i", stage(F.col("t")).alias("t")).orderBy("i").select("t").collect()]


def test_golden(spark):
    assert column(spark, [a for a, _ in GOLDEN], T.clean) == [b for _, b in GOLDEN]


def strings(alphabet, n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


#: Python's classes, in which \s and . follow ECMAScript as the stages' patterns spell it out.
WS, DOT = f"[{T.WS}]", f"[^{T.LT}]"


@pytest.mark.parametrize(
    "stage, patterns, to, alphabet",
    [
        (T.remove_page_numbers, T.PAGE_NUMBERS, "", ["Page", "page", " of ", " ", "1", "23", "\n", "\r", "-", "–", "x", " ", " "]),
        (T.clean_toc_leaders, [T.TOC_LEADERS], "", [" ", "...", ".", "··", "--", "7", "\n", "x", "\r"]),
        (T.clean_numbered_toc, [T.NUMBERED_TOC], r"\1", ["1", ".", " ", "x", "...", "\n", "2"]),
        (T.remove_leader_dot_lines, [f"{T.BOL}{DOT}{{20,}}(\\.{{3,}}{DOT}{{0,}}){{2,}}{T.EOL}"], "", ["abcdefghij", "...", ".", "\n", "x", "\r"]),
        (T.remove_headers_footers, [T.HEADERS], "", ["Confidential", "company name", "x", "\n", " ", "\r"]),
        (T.fix_line_breaks, [T.LINE_BREAK], " ", ["a", ".", "\n", ":", "\r"]),
        (T.remove_duplicate_lines, [T.REPEATED_LINE], r"\1", ["a", "b", "\n", "\n", "\r"]),
    ],
)
def test_stage_equals_regex(spark, stage, patterns, to, alphabet):
    texts = strings(alphabet, 400, 12, 5)
    expected = []
    for t in texts:
        for p in patterns:
            t = re.sub(p, to, t)
        expected.append(t)
    assert column(spark, texts, stage) == expected


def test_merge_repeats_equals_regex():
    for t in strings("ab.\n\n", 20_000, 14, 1) + strings("a\n\r", 5_000, 10, 2):
        assert T.merge_repeats(t) == re.sub(f"({DOT}*)(\\n\\1)+", r"\1", t), repr(t)


def test_merge_repeats_leaves_no_line_feed_and_is_quick():
    assert "\n" not in T.merge_repeats("a\n\nb\n" * 1000)
    long = "word " * 20_000
    assert T.merge_repeats(long + "\n" + long) == long


def test_dropped_stage_has_nothing_to_do(spark):
    for t in column(spark, [a for a, _ in GOLDEN], T.clean):
        assert re.sub(r"\n(?=[A-Z][A-Za-z\s]{3,}\n)", "\n\n", t) == t


def test_decode(spark):
    raw = [b"plain", "ü€😀".encode(), b"a\xffb", b"\xe2\x82", b"\xf0\x9f\x98x", b"", None]
    df = spark.createDataFrame([(i, bytearray(r) if r is not None else None) for i, r in enumerate(raw)], "i int, b binary")
    got = [r[0] for r in df.orderBy("i").select(T.decode_utf8(F.col("b"))).collect()]
    assert got == [None if r is None else r.decode("utf-8", "replace") for r in raw]


def test_section_spacing_would_change_nothing(spark):
    # No line feed outlives the paragraph stage, so setting headings apart by line feeds behind it has nothing to act on.
    rng = random.Random(4)
    texts = ["".join(rng.choice(["\n", "\n\n", "1. Intro", " ", "word.", "A"]) for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert not any("\n" in r[0] for r in df.select(T.clean(F.col("t"))).collect())
