"""Problem 9: one consistent form for texts that look the same.

The skeleton of a text: decompose, replace every character by its prototype, decompose again. Prototypes undo width forms,
ligatures and kinds of blanks, drop characters that show nothing, and give letters that Latin, Cyrillic and Greek share one
script. Accents, case, digits, punctuation, tabs and line breaks stay.

Defined results: the skeleton of a null text is null and of an empty text empty; a joiner between pictographs stays, as it
changes what is seen; a null or blank text has no look-alike.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.arrow import over_batches
from ragmill.session import materialise

# Letters of one shape in two scripts, with the form that stands for both.
SAME_SHAPE = [
    ("АВЕЅІЈКМНОРСТУХԚԜҮӀ", "ABESIJKMHOPCTYXQWYI"),  # Cyrillic capitals
    ("аеѕіјорсухԁԛԝһѵ", "aesijopcyxdqwhv"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),  # Greek capitals
    ("ονρϲϳ", "ovpcj"),  # Greek small letters
    ("ΓΠΦ", "ГПФ"),  # Greek capitals that only Cyrillic shares
    ("\u0474\u050c\u04d4\u04d8\u04e0\ua644", "VG\u00c6\u018f\u01b7\u01a7"),  # more Cyrillic capitals
    ("\u04cf\u04d5\u04d9\u04e1\ua645", "l\u00e6\u0259\u0292\u01a8"),  # more Cyrillic small letters
    ("\u03dc\u03fa\u01a9\u0470\u0471", "FM\u03a3\u03a8\u03c8"),  # digamma, san, esh and sigma, psi
    ("\u0472\u04e8\u019f\u0473\u04e9", "\u0398\u0398\u0398\u0275\u0275"),  # theta, fita and barred o
    ("\u00b5\u0269\u03b9\ua647", "\u03bc\u0131\u0131\u0131"),  # micro sign and mu; iota of three scripts and dotless i
    ("\u03b1\u0251\u03c5\u028b\u0261", "aauug"),  # Greek alpha and upsilon, Latin alpha, v with hook and script g
    ("\u03ba\u0138", "\u043a\u043a"),  # small kappa and kra, as Cyrillic ka
    ("\u0196\u0186\u0421", "I\u03fdC"),  # Latin capital iota, open O and the reversed sigma of Greek
    ("\u03f3\u0458\u0237", "jj\u0237"),  # yot and je
    ("\u0190\u0404\u03f5\u0454\u025b\u03b5", "\u0190\u0404\u0454\u0454\u025b\u025b"),  # open e and epsilon, Ukrainian ie
    ("\u0194\u0263\u03c6\u0278\u0444\u03c9\ua7b7\u0461", "\u0194\u0263\u0278\u0278\u0444\u0461\u0461\u0461"),  # phi, omega of three scripts
    ("\u0398\u03f4\u03b8\u03d1", "\u0398\u0398\u03b8\u03d1"),  # theta and its symbol
    ("\u03b4\u1e9f\u03c7\uab53\u03b2\ua7b5", "\u03b4\u03b4\u03c7\u03c7\u03b2\u03b2"),  # delta, chi and beta as Latin letters
    ("\ua7b3\u0245\u019c", "X\u039b\u019c"),  # Latin capital chi and turned v
]
# Characters other than format characters and variation selectors that show nothing.
SHOW_NOTHING = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
JOINER = "\u200d"


@functools.lru_cache(maxsize=1)
def prototypes() -> dict[int, str]:
    """Code point -> prototype, derived from the character database where a rule holds."""
    table: dict[int, str] = {}
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        kind = unicodedata.category(char)
        if kind in ("Cn", "Co", "Cs"):
            continue
        parts = unicodedata.decomposition(char).split()
        if kind == "Zs":
            table[point] = " "
        elif kind == "Cf" or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF or 0x180B <= point <= 0x180D:
            table[point] = ""
        elif parts and parts[0] in ("<wide>", "<narrow>"):
            table[point] = "".join(chr(int(x, 16)) for x in parts[1:])
        elif parts and parts[0] == "<compat>" and kind in ("Ll", "Lu", "Lt") and len(parts) > 2 and all(chr(int(x, 16)).isalpha() for x in parts[1:]):
            table[point] = unicodedata.normalize("NFKD", char)  # ligatures and digraphs
    for seen, prototype in SAME_SHAPE:
        table.update(zip(map(ord, seen), prototype))
    table.update((ord(c), "") for c in SHOW_NOTHING)
    del table[ord(JOINER)]
    return table


def _joins_pictographs(text: str) -> str:
    out = []
    for i, char in enumerate(text):
        if char == JOINER:
            before = text[max(0, i - 8) : i].rstrip("\ufe0f" + JOINER)[-1:]
            after = text[i + 1 : i + 2]
            if not (before and after and unicodedata.category(before) in ("So", "Sk") and unicodedata.category(after) in ("So", "Sk")):
                continue
        out.append(char)
    return "".join(out)


def skeleton(text: str | None) -> str | None:
    """The form that all texts of one look share."""
    if not text or text.isascii():
        return text
    table = prototypes()
    if JOINER in text:
        text = _joins_pictographs(text)
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def canonical_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, canonical): each row's text in the consistent form, composed again for use (NFC of the skeleton)."""

    def make():
        def work(batch: pa.RecordBatch):
            forms = [t if t is None or t.isascii() else unicodedata.normalize("NFC", skeleton(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=[key, "canonical"])

        return work

    return over_batches(df.select(key, text), make, f"`{key}` {df.schema[key].dataType.simpleString()}, canonical string")


def skeleton_hashes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, look, own): 128-bit hashes of the skeleton and of the text itself; rows without visible text are left out."""
    import hashlib

    def make():
        digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

        def work(batch: pa.RecordBatch):
            look, own = [], []
            for t in batch.column(1).to_pylist():
                form = skeleton(t)
                if not form or form.isspace():
                    look.append(None), own.append(None)
                    continue
                own.append(digest(t))
                look.append(own[-1] if form is t or form == t else digest(form))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(look, pa.binary()), pa.array(own, pa.binary())], names=["key", "look", "own"])
            yield out.filter(pc.is_valid(out.column(1)))

        return work

    kind = df.schema[key].dataType.simpleString()
    return over_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), make, f"key {kind}, look binary, own binary")


def look_alikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, look, own) of the rows whose look has several spellings, written once. Looks that only one spelling has drop out on
    a pre-aggregated count before any row meets another."""
    hashes = materialise(skeleton_hashes(df, key, text), "looks")
    spellings = hashes.select("look", "own").distinct()
    several = spellings.groupBy("look").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("look")
    return hashes.join(several, "look", "left_semi")


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, spelling_id): one row per row that has a look-alike; the ids are the smallest keys of the rows of one look
    and of one spelling. It grows with the rows, however many of them share a look."""
    rows = look_alikes(df, key, text)
    spelled = rows.groupBy("look", "own").agg(F.min("key").alias("spelling_id"))
    classes = spelled.groupBy("look").agg(F.min("spelling_id").alias("class_id"))
    return rows.join(spelled.join(classes, "look"), ["look", "own"]).select("key", "class_id", "spelling_id")


def look_alike_pairs(df: DataFrame, key: str, text: str, left: str, right: str) -> DataFrame:
    """(left, right): keys of rows that look the same but differ in code points, smaller key first. Pairs are formed between
    spellings, each once, and spread over the rows of both; AQE splits what is hot."""
    rows = materialise(look_alikes(df, key, text), "look-alikes")
    spelled = rows.select("look", "own").distinct()
    pairs = spelled.withColumnRenamed("own", "own_a").join(spelled.withColumnRenamed("own", "own_b"), "look").where("own_a < own_b")
    a = rows.select(F.col("look"), F.col("own").alias("own_a"), F.col("key").alias("x"))
    b = rows.select(F.col("look"), F.col("own").alias("own_b"), F.col("key").alias("y"))
    met = pairs.join(a, ["look", "own_a"]).join(b, ["look", "own_b"]).where("x <> y")
    return met.select(F.least("x", "y").alias(left), F.greatest("x", "y").alias(right)).distinct()
