"""Scanned pages (2), site lines (3), splitting (4), encoding (7), packing (8), look-alikes (9)."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ragmill.llm import boilerplate, lookalikes, packing, pages, splitting, tokens

META = "struct<source:string,mimeType:string,page:int,totalPages:int,chunk:int,totalChunks:int,extra:map<string,string>>"
needs_vocabulary = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZER_DIR), reason="no vocabularies here")


# -- 2 ------------------------------------------------------------------------------------------------------------------

WORDS = "boiler gasket turbine ledger harbour kitchen window portable document inspection temperature agreement".split()


def book(rng, file_no, n):
    """Pages of one scanned file: (content, page, lines that are furniture, split, misread)."""
    title = f"The {rng.choice(WORDS)} handbook"
    for page in range(1, n + 1):
        lines, truth = [title, ""], {"furniture": {1}, "split": set(), "misread": set()}
        for _ in range(14):
            lines.append(" ".join(rng.choice(WORDS) for _ in range(7)) + ".")
        at = rng.randrange(3, 14)
        lines[at - 1] = lines[at - 1][:-1] + " inspec-"
        lines[at] = "tion " + lines[at]
        truth["split"].add(at)
        at = rng.choice([i for i in range(3, 16) if i not in (at, at + 1)])
        words = lines[at - 1].split()
        printed, seen = rng.choice([(p, s) for p, s in (("e", "c"), ("o", "0"), ("i", "1"), ("a", "o"), ("t", "f"), ("n", "ri")) if p in words[2]])
        words[2] = words[2].replace(printed, seen, 1)
        lines[at - 1] = " ".join(words)
        truth["misread"].add(at)
        lines += ["", f"- {page} -"]
        truth["furniture"].add(len(lines))
        yield "\n".join(lines), page, truth


def page_table(spark, rows):
    data = [(k, f, c, (None, m, p, None, None, None, None)) for k, f, c, m, p in rows]
    return spark.createDataFrame(data, f"rec_no long, file_no long, content string, metadata {META}")


def test_pages(spark):
    rng = random.Random(1)
    rows, want, key = [], set(), 0
    for f in range(12):
        for content, page, truth in book(rng, f, 4):
            key += 1
            rows.append((key, f, content, pages.PDF, page))
            want |= {(key, n, kind) for kind, lines in truth.items() for n in lines}
    rows += [(900, None, None, pages.PDF, 1), (901, 1, "  \n", pages.PDF, None), (902, 1, "plain text", "text", None), (903, None, "x", None, None)]
    df = page_table(spark, rows)
    got = {tuple(r) for r in pages.found_lines(df, "rec_no").collect()}
    assert got == want
    text = {r.key: r.text for r in pages.paragraphs(df, "rec_no").collect()}
    assert len(text) == len(rows) and text[902] == "plain text" and text[900] is None
    assert "inspection" in text[1] and "inspec-" not in text[1] and "handbook" not in text[1]


def test_page_numbers():
    for line, number in (("- 12 -", 12), ("Page 3 of 9", 3), ("[7]", 7), ("xiv", 14), ("  41 ", 41), ("5 | Title here", 5), ("Title here    6", 6), ("p. 8", 8)):
        assert pages.page_number(line)[1] == number
    for line in ("mix", "iiii", "The 5th item", "", "a b 3"):
        assert pages.page_number(line) is None


def test_compounds_keep_their_hyphen():
    corpus = pages.Corpus({"water": 50, "tight": 50, "window": 90}, {"water-tight": 30}, frozenset(), frozenset())
    assert pages.hyphenation(corpus, "water", "-", "tight") == ("compound", None)
    assert pages.hyphenation(corpus, "win", "-", "dow") == ("split", None)
    assert pages.hyphenation(corpus, "win", "¬", "d0w") == ("split", "window")
    assert pages.hyphenation(corpus, "win", "-", "") is None


def test_two_misreadings_of_any_kind_and_words_of_any_length():
    long = "betriebskostenabrechnungsunterlagenverzeichnisse"
    corpus = pages.Corpus({"the": 5000, "running": 50, "modern": 60, "inspection": 50, long: 40}, {}, frozenset(), frozenset())
    assert corpus.repair("tbe") == "the"
    assert corpus.repair("rurming") == "running"  # nn as rm
    assert corpus.repair("rnoclern") == "modern"  # m as rn, d as cl
    assert corpus.repair("lnspectlon") == "inspection"  # i as l, twice
    assert corpus.repair(long.replace("t", "f", 1).replace("verz", "vcrz")) == long
    assert corpus.repair("modern") is None and corpus.repair("zzzz") is None


def test_two_misreadings_are_found_as_by_trying_all():
    rng = random.Random(5)
    letters = "acdehilmnorstu"
    known = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(3000)]
    corpus = pages.Corpus({w: rng.randint(4, 400) for w in known}, {}, frozenset(), frozenset())

    def undone(word, start):
        for read, printed in pages.MISREADINGS:
            at = word.find(read, start)
            while at >= 0:
                yield word[:at] + printed + word[at + len(read) :], at + len(printed)
                at = word.find(read, at + 1)

    for _ in range(300):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(3, 7)))
        if word in corpus.words:
            continue
        once = {w for w, _ in undone(word, 0)} & corpus.words.keys()
        twice = {w for first, at in undone(word, 0) for w, _ in undone(first, at)} & corpus.words.keys()
        best = min(once or twice, key=lambda w: (-corpus.words[w], w), default=None)
        assert corpus.repair(word) == best


def test_pages_are_read_alike_whatever_vocabulary_every_task_has(spark, data, monkeypatch):
    records = spark.read.parquet(f"{data}/handler_docs.parquet")
    run = lambda: (sorted(pages.found_lines(records, "rec_no").collect()), sorted(pages.paragraphs(records, "rec_no").collect()))
    whole = run()
    monkeypatch.setattr(pages, "KNOWN_SHARE", 2e-3)  # most words are read from files
    monkeypatch.setattr(pages, "RARE_TOGETHER", 50)
    assert len(whole[0]) > 50 and run() == whole


def test_headers_of_a_chapter_in_a_large_file(spark):
    rng = random.Random(12)
    rows, truth = [], set()
    body = lambda: " ".join(rng.choice(WORDS) for _ in range(7)) + "."
    again = body()  # a sentence that begins some pages is no header
    for page in range(1, 901):
        lines = [body() for _ in range(6)]
        if 100 <= page < 112:
            lines.insert(0, "Chapter on seals" if page != 105 else "Chaptcr on seals")
            truth.add((page, 1))
        elif page % 60 == 0:
            lines.insert(0, again)
        rows.append((page, 1, "\n".join(lines), (None, "application/pdf", page, 900, None, None, None)))
    df = spark.createDataFrame(rows, f"rec_no long, file_no long, content string, metadata {META}")
    got = {(r.key, r.line_no) for r in pages.found_lines(df, "rec_no").where("kind = 'furniture'").collect()}
    assert got == truth


def test_alike_lines_are_found_as_by_comparing_all():
    rng = random.Random(8)
    letters = "aeinrst "

    def edited(line):
        for _ in range(rng.randint(0, len(line) // 4)):
            at = rng.randrange(len(line))
            line = rng.choice((line[:at] + line[at + 1 :], line[:at] + rng.choice(letters) + line[at:], line[:at] + rng.choice(letters) + line[at + 1 :]))
        return line.strip()

    lines = ["".join(rng.choice(letters) for _ in range(rng.choice((4, 9, 20, 40, 140)))).strip() for _ in range(120)]
    few, found = pages.FewLines(lines), 0
    for line in lines * 6:
        key = edited(line)
        want = any(pages.alike(key, l) for l in few.lines)
        assert few.has(key) == want
        found += want
    assert 200 < found < 700
    assert pages.FewLines(["seals gaskets"]).has("scals gaskcts")  # no word in common


def test_lines_of_any_length_are_compared():
    header = "the annual collection of service instructions for boilers turbines and pumps " * 3
    assert pages.alike(header, header.replace("service", "scrvice")) and not pages.alike(header, header[::-1])
    rng = random.Random(9)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next_row(row, x, b)
        assert pages.in_common(a, b) == row[-1]


def _next_row(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


def test_long_headers(spark):
    rng = random.Random(13)
    title = " ".join(rng.choice(WORDS) for _ in range(22))
    rows = [(p, 1, "\n".join([title if p != 3 else title.replace("e", "c", 2), *(" ".join(rng.choice(WORDS) for _ in range(7)) + "." for _ in range(6))]), pages.PDF, p) for p in range(1, 7)]
    assert len(title) > 150
    got = {(r.key, r.line_no) for r in pages.found_lines(page_table(spark, rows), "rec_no").where("kind = 'furniture'").collect()}
    assert got == {(p, 1) for p in range(1, 7)}


def test_lines_that_recur_on_few_of_very_many_pages(spark):
    # Unlike bodies, so that only the header recurs: on 8 of 60,000 pages.
    body = F.translate(F.md5(F.col("id").cast("string")), "0123456789", "ghijklmnop")
    text = F.when(F.col("id") % 7000 == 3, F.concat(F.lit("Chapter on seals\n"), body)).otherwise(body)
    rows = spark.range(60_000).select(F.lit("f1").alias("file"), text.alias("content"), F.col("id").cast("int").alias("page"), F.lit(True).alias("pdf"))
    known, few = pages.file_furniture(rows)
    assert [(r.known, r.few) for r in known.collect()] == [([], True)] and few.of("f1").lines == {"chapter on seals"}


def test_forms_of_headers_count_whatever_the_number_of_words(spark):
    rows = [(i, i, "Some words zwieback\nbody text goes on here.\nmore of it.\nand an end.", pages.PDF, 1) for i in range(9)]
    rows += [(100 + i, 100 + i, "a " * 1_000_000, "text", None) for i in range(12)]
    corpus = pages.corpus_of(pages.pdf_rows(page_table(spark, rows), "rec_no"))
    assert "zwieback" in corpus.last
    assert pages._edge_line("Other zwicback", corpus) and not pages._edge_line("Other zwicbock", corpus)


def test_long_rare_words_are_repaired(spark, monkeypatch):
    monkeypatch.setattr(pages, "KNOWN_SHARE", 0.2)  # most words are read from files
    long = "betriebskostenabrechnungsunterlagenverzeichnisse" * 2
    seen = long.replace("t", "f", 1)[:-3] + "ssc"
    rows = [(i, i, f"the {long} the the the the\nmore here.", pages.PDF, None) for i in range(6)] + [(9, 9, f"the {seen} the.", pages.PDF, None)]
    got = {(r.key, r.line_no) for r in pages.found_lines(page_table(spark, rows), "rec_no").where("kind = 'misread'").collect()}
    assert got == {(9, 1)}


def test_a_long_word_is_cut_at_the_end_of_a_line():
    long = "x" * 200
    assert pages._tail(f"and {long}-  ") == (long, "-") and pages._tail(" -") is None and pages._tail("") is None


def test_page_numbers_in_long_lines():
    assert pages.page_number("12 | " + "a title that goes on " * 8) == ("bar", 12)


def test_no_pages(spark):
    df = page_table(spark, [(1, 1, "x", "text", None)])
    assert pages.found_lines(df.where("false"), "rec_no").count() == 0
    assert pages.found_lines(df, "rec_no").count() == 0


# -- 3 ------------------------------------------------------------------------------------------------------------------


def test_sites(spark):
    names = {
        "docs.a.example/x/y.txt": "docs.a.example", "HTTPS://www.A.example:8080\\z.txt": "a.example", "a.example:80/x": "a.example",
        "scan_1.pdf": None, "minutes (1).txt": None, "folder/file.txt": None, None: None, "": None, "http://b.example": "b.example", " www.b.example/x": "b.example",
    }
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", boilerplate.site_of(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == names


def site_tables(spark, rng, sites=3, records=60):
    common = ["Share this page (4)", " All  rights reserved 2020", "By someone"]
    files, rows = [], []
    for f in range(sites * records):
        files.append((f, f"s{f % sites}.example/p{f}.txt"))
        lines = [rng.choice(["alpha", "beta", "gamma"]) + f" line {rng.randint(0, 10**6)} x{'abcdefgh'[rng.randrange(8)]}" * 3 for _ in range(5)]
        lines += [c.upper() if rng.random() < 0.5 else c for c in common if rng.random() < 0.25]
        rng.shuffle(lines)
        rows.append((f, f, "\n".join(lines) if f % 17 else rng.choice([None, "", "12 34\n \n"])))
    rows.append((10_000, 99_999, "no file"))
    return spark.createDataFrame(files, "file_no long, originalname string"), spark.createDataFrame(rows, "rec_no long, file_no long, content string"), dict(files), rows


@pytest.mark.parametrize("counters", [4096, 8])
def test_site_lines_equal_brute_force(spark, counters):
    files, records, names, rows = site_tables(spark, random.Random(2))
    site = {k: names.get(f, "/").split("/")[0] for k, f, _ in rows}
    of, n = {}, {}
    for k, _, content in rows:
        n[site[k]] = n.get(site[k], 0) + 1
        for line in {boilerplate.line_key(x) for x in (content or "").split("\n")}:
            of.setdefault((site[k], line), set()).add(k)
    often = lambda s, x: x and s and len(of[s, x]) >= max(8, n[s] * 0.2 - 1e-9)
    want = {(k, i) for k, _, c in rows for i, x in enumerate((c or "").split("\n"), 1) if c and often(site[k], boilerplate.line_key(x))}
    assert want
    lines = boilerplate.confirmed(boilerplate.site_rows(records, files, "rec_no", "content"), counters=counters)
    assert lines.count() == len({(s, x) for s, x in of if often(s, x)})
    assert {tuple(r) for r in boilerplate.found_lines(records, files, "rec_no", "content").collect()} == want
    clean = {r.key: r.content for r in boilerplate.cleaned(records, files, "rec_no", "content").collect()}
    for k, _, c in rows:
        kept = None if c is None else "\n".join(x for i, x in enumerate(c.split("\n"), 1) if (k, i) not in want)
        assert clean[k] == kept
    assert boilerplate.found_lines(records.where("false"), files, "rec_no", "content").count() == 0


# -- 4 ------------------------------------------------------------------------------------------------------------------


def test_split_gives_the_text_back():
    rng = random.Random(3)
    bits = ["word ", "longer-word ", "End. ", "Stop!\n", "\n\n", "clause, ", "x" * 30, "日本。", " ", "  "]
    for _ in range(600):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        size = rng.randint(1, 60)
        overlap = rng.randint(0, size - 1)
        found = splitting.split(text, size, overlap)
        assert "".join(text[a:b] for a, b, _ in found) == text
        assert all(b - a + (min(overlap, a) if i else 0) <= size for i, (a, b, _) in enumerate(found))


def test_strongest_breaks_stay():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten eleven."
    assert [text[a:b] for a, b, _ in splitting.split(text, 40, 0)] == ["One two three. Four five six.\n\n", "Seven eight nine. Ten eleven."]
    assert [s for _, _, s in splitting.split("aa bb cc", 3, 0)] == [splitting.WORD, splitting.WORD, splitting.PARAGRAPH]


def test_split_records(spark):
    options = spark.createDataFrame([(1, 10, 2), (2, None, None), (3, 5, 5), (4, 0, 0), (5, 4, None), (6, 6, -1)], "opt_no int, chunkSize int, overlap int")
    rows = [(1, 1, "aaa bbb ccc ddd"), (2, None, "x" * 1001), (3, 3, "too long"), (4, 4, "too long"), (5, 5, "abcdefgh"), (6, 6, "too long"), (7, 1, None), (8, 1, ""), (9, 2, "y " * 600), (10, 77, "short")]
    df = spark.createDataFrame(rows, "k int, opt_no int, text string").withColumn("size", F.lit(1))
    got = splitting.split_records(df, options, "k", "text").collect()
    assert {(r.key, r.kind) for r in got} == {(1, "natural"), (2, "forced"), (5, "forced"), (8, None), (9, "natural"), (10, None)}
    assert [(r.text, r.overlap) for r in sorted(got, key=lambda r: r.piece_no) if r.key == 1] == [("aaa bbb ", 0), ("b ccc ddd", 2)]
    assert {(r.key, r.kind) for r in splitting.split_records(df, options, "k", "text", only_oversized=True).collect()} == {(1, "natural"), (2, "forced"), (5, "forced"), (9, "natural")}


# -- 7 ------------------------------------------------------------------------------------------------------------------

TEXTS = ["", "Hello world", " lead", "trail ", "a  b", "a   b\n \n c", "\n\n  x y\t z ", "don't we'll'd I'M", "<|endoftext|> here", "É́ 日本語 \U0001f600‍\U0001f527", "a b 　c", "x" * 500 + " " + "y1" * 300, "café\r\nnaïve", "▁ under", "3.14 == 22/7;  ok"]


@needs_vocabulary
def test_encoding_equals_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice(TEXTS + [" ", "\n", ".", "ab"]) for _ in range(6)) for _ in range(200)]
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(texts)] + [(-1, None, "z")], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, "doc_id", "text").collect()}
    assert got.pop(-1) == []
    assert got == {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}
    ids = tokens.encode_corpus(df, "doc_id", "text")
    back = {r.doc_id: r.text for r in tokens.decode_corpus(ids, "doc_id", "ids").collect()}
    assert all(back[i] == x for i, x in enumerate(texts))
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, ["doc_id"], "text").collect()}[1] == 2
    assert tokens.encode_corpus(df.where("false"), "doc_id", "text").count() == 0


# -- 8 ------------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(6)
    sizes = [rng.choice([0, 1, 5, 40, 99, 100, 101, 250]) if rng.random() < 0.3 else rng.randint(1, 60) for _ in range(3000)] + [None, -3]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc long, size long, bin_no string").repartition(6)
    got = packing.pack(df, "doc", "size", capacity=100, open_bins=16).collect()
    bins, parts = {}, {}
    for r in got:
        parts.setdefault(r.doc, []).append((r.piece_no, r["size"]))
        if r.bin_no is not None:
            bins[r.bin_no] = bins.get(r.bin_no, 0) + r["size"]
    assert all(n <= 100 for n in bins.values())
    for i, s in enumerate(sizes):
        s = max(s or 0, 0)
        want = [100] * (s // 100) + ([s % 100] if s % 100 else []) or [0]
        assert [n for _, n in sorted(parts[i])] == want
    total = sum(max(s or 0, 0) for s in sizes)
    assert total / (100 * len(bins)) > 0.97
    assert packing.pack(df.where("false"), "doc", "size", 100).count() == 0


def test_fullest_closes_first():
    bins = packing.BestFit(10, 2)
    assert bins.put(6) == (0, None, False)
    assert bins.put(5) == (1, None, False)
    assert bins.put(4) == (0, None, True)  # the tightest fit
    assert bins.put(7) == (2, None, False)
    assert bins.put(9) == (3, (2, 3), False)  # both open ones are too full: the fuller closes


@needs_vocabulary
def test_packing_of_texts(spark):
    df = spark.createDataFrame([(1, "word " * 50), (2, None), (3, ""), (4, "one two")], "k long, t string")
    got = {}
    for r in packing.pack_texts(df, "k", "t", capacity=20).collect():
        got.setdefault(r.k, []).append(r["size"])
    assert sum(got[1]) == 51 and len(got[1]) == 3 and got[2] == got[3] == [0] and got[4] == [2]


# -- 9 ------------------------------------------------------------------------------------------------------------------

ALIKE = [("ｐａｇｅ", "page"), ("été", "été"), ("ﬁne", "fine"), ("a​b­", "ab"), ("a b　c", "a b c"), ("Раgе", "Page"), ("ё", "ë"), ("Οο", "Oo"), ("ﾊﾞ", "バ")]
DIFFERENT = [("a b", "a  b"), ("a\tb", "a b"), ("a\nb", "a b"), ("x²", "x2"), ("e", "é"), ("Page", "page"), ("1", "l"), ("0", "O"), ("…", "..."), ("–", "-"), ("\U0001f469‍\U0001f527", "\U0001f469\U0001f527"), ("и", "u")]


def test_skeletons():
    for a, b in ALIKE:
        assert lookalikes.skeleton(a) == lookalikes.skeleton(b), (a, b)
    for a, b in DIFFERENT:
        assert lookalikes.skeleton(a) != lookalikes.skeleton(b), (a, b)
    for a, b in ALIKE + DIFFERENT:
        for t in (a, b):
            assert lookalikes.skeleton(lookalikes.skeleton(t)) == lookalikes.skeleton(t)


def test_rarer_letters_of_one_shape_both_ways():
    for seen, as_ in ("\u0474V", "\u04cfl", "\u050cG", "\u04d4\u00c6", "\u04d5\u00e6", "\u04d8\u018f", "\u04d9\u0259", "\u0472\u0398", "\u04e8\u0398", "\u00b5\u03bc"):
        assert lookalikes.skeleton(f"a{seen}b") == lookalikes.skeleton(f"a{as_}b")
    for seen, prototype in lookalikes.SAME_SHAPE:
        assert len(seen) == len(prototype)
        for a, b in zip(seen, prototype):
            assert lookalikes.skeleton(a) == lookalikes.skeleton(b) == lookalikes.skeleton(lookalikes.skeleton(a)), (a, b)


def test_look_alike_pairs(spark):
    texts = [t for pair in ALIKE for t in pair] + ["page", "page", None, "", " ", " ", "lone"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc long, text string, look string")
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and texts[j] and texts[i].strip() and texts[j].strip() and texts[i] != texts[j] and lookalikes.skeleton(texts[i]) == lookalikes.skeleton(texts[j])}
    got = lookalikes.look_alike_pairs(df, "doc", "text", "a", "b").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert lookalikes.look_alike_pairs(df.where("false"), "doc", "text", "a", "b").count() == 0
    forms = {r.doc: r.canonical for r in lookalikes.canonical_texts(df, "doc", "text").collect()}
    assert forms[0] == "page" and forms[texts.index(None)] is None


# -- very long texts ----------------------------------------------------------------------------------------------------


def test_very_long_texts(spark):
    long = ["e" * 2_000_000, "wood " * 300_000, "\U0001f469\u200d" * 200_000, "a\n" * 300_000, "x-\ny " * 100_000]
    df = page_table(spark, [(i, i, t, pages.PDF, None) for i, t in enumerate(long)]).withColumn("opt_no", F.lit(1))
    assert pages.paragraphs(df, "rec_no").count() == len(long)
    options = spark.createDataFrame([(1, 1000, 100)], "opt_no int, chunkSize int, overlap int")
    pieces = splitting.split_records(df, options, "rec_no", "content").groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()
    assert {r.key: r.n for r in pieces} == {i: len(t) for i, t in enumerate(long)}
    assert lookalikes.look_alike_pairs(df, "rec_no", "content", "a", "b").count() == 0
    files = spark.createDataFrame([(i, "s.example/x") for i in range(len(long))], "file_no long, originalname string")
    assert boilerplate.found_lines(df, files, "rec_no", "content").count() == 0
    if os.path.isdir(tokens.TOKENIZER_DIR):
        ids = tokens.encode_corpus(df, "rec_no", "content")
        assert {r.rec_no: r.text for r in tokens.decode_corpus(ids, "rec_no", "ids").collect()} == dict(enumerate(long))
