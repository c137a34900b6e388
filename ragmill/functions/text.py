"""The text cleaner: ten ordered stages as Column expressions, and the one fold that needs Python.

Patterns follow ECMAScript's rules: ``\\s`` includes no-break spaces and the byte-order mark, and lines end at LF, CR, U+2028
and U+2029 only. Both classes are written out, because Java's differ.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white-space and line-end classes, and the patterns of the cleaning stages.
WS = r"\t\n\x0B\f\r\u0020\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
LT = r"\n\r\u2028\u2029"
S, DOT = f"[{WS}]", f"[^{LT}]"
BOL, EOL = f"(?<![^{LT}])", f"(?![^{LT}])"
DASHES = "[-–—]"
PAGE_NUMBERS = [
    f"(?i){BOL}{S}*Page{S}+[0-9]+({S}+of{S}+[0-9]+)?{S}*{EOL}",
    f"{BOL}{S}*[0-9]+({S}+of{S}+[0-9]+)?{S}*{EOL}",
    f"{BOL}{S}*{DASHES}+{S}*[0-9]+{S}+of{S}+[0-9]+{S}*{DASHES}+{S}*{EOL}",
    f"{BOL}{S}*{DASHES}+{S}*[0-9]+{S}*{DASHES}+{S}*{EOL}",
]
TOC_LEADERS = rf"{S}(?:\.{{3,}}|·{{2,}}|{DASHES}{{2,}}){S}*[0-9]+{S}*{EOL}"
NUMBERED_TOC = rf"{BOL}([0-9]+(?:\.[0-9]+)*{S}+{DOT}+?)(?:{S}\.{{3,}}{S}*[0-9]+){S}*{EOL}"
#: Two runs of three dots behind twenty characters, in a form without nested quantifiers.
LEADER_DOTS = rf"{BOL}{DOT}{{20,}}\.{{3}}{DOT}*\.{{3}}{DOT}*{EOL}"
HEADERS = f"(?i){BOL}(?:Company Name|Document Title|Confidential){DOT}*"
LINE_BREAK = r"(?<![.!?:])\n(?!\n)"
BLANK_LINES = r"\n{3,}"
REPEATED_LINE = rf"{BOL}({DOT}+)(?:\n\1)+{EOL}"
ENDS = f"^{S}+|{S}+$"


def _where(text: Column, test: Callable[[Column], Column], stage: Callable[[Column], Column]) -> Column:
    """``stage`` where a cheap test finds that it may have something to do. The text is computed once: the lambda's argument
    is the only place that names it."""
    return F.transform(F.array(text), lambda t: F.when(test(t), stage(t)).otherwise(t)).getItem(0)


def _replace(pattern: str, to: str = "") -> Callable[[Column], Column]:
    return lambda t: F.regexp_replace(t, pattern, to)


def remove_page_numbers(text: Column) -> Column:
    starts = lambda chars: lambda t: t.rlike(f"(?:^|[{LT}]){S}*[{chars}]")
    tests = (lambda t: F.lower(t).contains("page"), starts("0-9"), starts("-–—"), starts("-–—"))
    for test, pattern in zip(tests, PAGE_NUMBERS):
        text = _where(text, test, _replace(pattern))
    return text


def clean_toc_leaders(text: Column) -> Column:
    return _where(text, lambda t: t.rlike(rf"\.{{3}}|·{{2}}|{DASHES}{{2}}"), _replace(TOC_LEADERS))


def clean_numbered_toc(text: Column) -> Column:
    return _where(text, lambda t: t.contains("..."), _replace(NUMBERED_TOC, "$1"))


def remove_leader_dot_lines(text: Column) -> Column:
    return _where(text, lambda t: t.contains("..."), _replace(LEADER_DOTS))


def remove_headers_footers(text: Column) -> Column:
    return _where(text, lambda t: t.rlike("(?i)Company Name|Document Title|Confidential"), _replace(HEADERS))


def fix_line_breaks(text: Column) -> Column:
    return F.regexp_replace(text, LINE_BREAK, " ")


def normalize_paragraphs(text: Column) -> Column:
    return F.regexp_replace(text, BLANK_LINES, "\n\n")


def remove_duplicate_lines(text: Column) -> Column:
    return _where(text, lambda t: t.contains("\n"), _replace(REPEATED_LINE, "$1"))


def trim(text: Column) -> Column:
    at_end = lambda t: F.substring(t, 1, 1).rlike(S) | F.substring(t, -1, 1).rlike(S)
    return _where(text, at_end, _replace(ENDS))


def merge_repeats(text: str) -> str:
    """Join the text's lines, dropping what the next line repeats of the end of the one before.

    Between two lines the longest end of the first that the second begins with is kept once, and as long as the lines after
    go on with it, that is dropped from them too; every line feed goes. A kept end never reaches back over CR, U+2028 or
    U+2029. Linear but for lines full of one character.
    """
    lines = text.split("\n")
    out, rest, shared = [], lines[0], ""
    for line in lines[1:]:
        if not rest and shared and line.startswith(shared):
            rest = line[len(shared) :]
        else:
            at = _overlap(rest, line)
            out.append(rest[:at])
            shared = rest[at:]
            out.append(shared)
            rest = line[len(shared) :]
        if rest:
            shared = ""
    out.append(rest)
    return "".join(out)


def _overlap(rest: str, line: str) -> int:
    """Where the longest end of ``rest`` that begins ``line`` starts; len(rest) if none does."""
    if not rest or not line:
        return len(rest)
    start = max(0, len(rest) - len(line), *(rest.rfind(c) + 1 for c in "\r\u2028\u2029"))
    at = rest.find(line[0], start)
    while at >= 0:
        if line.startswith(rest[at:]):
            return at
        at = rest.find(line[0], at + 1)
    return len(rest)


@F.pandas_udf(StringType())
def remove_duplicate_paragraphs(text: pd.Series) -> pd.Series:
    return text.map(merge_repeats, na_action="ignore")


#: The stages in their order. None of the text's line feeds outlives ``remove_duplicate_paragraphs``, so a stage that would
#: set section headings apart after it has nothing to act on and is left out.
STAGES = (
    remove_page_numbers,
    clean_toc_leaders,
    clean_numbered_toc,
    remove_leader_dot_lines,
    remove_headers_footers,
    fix_line_breaks,
    normalize_paragraphs,
    remove_duplicate_lines,
    remove_duplicate_paragraphs,
    trim,
)


def clean(text: Column) -> Column:
    """All stages; a null text is the empty text."""
    text = F.coalesce(text, F.lit(""))
    for stage in STAGES:
        text = stage(text)
    return text


def decode_utf8(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))
