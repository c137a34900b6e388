import random

import pytest

from ragmill.operators.chunking import SEPARATORS, ChunkingOptions, RecursiveChunker, SlidingWindowChunker, chunk_rows


def texts(alphabet, n, longest, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("size", range(1, 12))
def test_short_form_equals_recursion(size):
    chunker = RecursiveChunker(ChunkingOptions(size))
    for t in texts("ab  c", 1500, 30):
        assert chunker(t) == chunker._split(t, SEPARATORS) if size > 1 else True, repr(t)


@pytest.mark.parametrize("size, overlap", [(5, 0), (8, 3), (20, 7), (12, 11)])
def test_chunks_fit_and_keep_the_text(size, overlap):
    chunker = RecursiveChunker(ChunkingOptions(size, overlap))
    for t in texts("abcd ef\n\n.", 800, 80):
        chunks = chunker(t)
        assert all(1 <= len(c) <= size and c == c.strip() for c in chunks)
        if not overlap:
            assert "".join("".join(chunks).split()) == "".join(t.split())


def test_paragraphs_before_lines_before_words():
    chunker = RecursiveChunker(ChunkingOptions(12))
    assert chunker("one two\n\nthree four\nfive") == ["one two", "three four", "five"]
    assert RecursiveChunker(ChunkingOptions(10, 4))("aaa bbb ccc ddd") == ["aaa bbb", "bbb ccc", "ccc ddd"]


def test_options():
    for bad in ((10, 10), (10, 11), (0, None), (5, -1)):
        with pytest.raises(ValueError):
            ChunkingOptions(*bad)
    with pytest.raises(ValueError, match="Overlap must be smaller than chunk size."):
        ChunkingOptions(10, 10)


def test_utf16_counts_units():
    assert RecursiveChunker(ChunkingOptions(2))("😀😀") == ["😀😀"]
    assert RecursiveChunker(ChunkingOptions(2, utf16=True))("😀😀") == ["😀", "😀"]


def test_rows(spark):
    df = spark.createDataFrame([(1, "aa bb cc"), (2, ""), (3, None), (4, "x")], "id int, text string")
    got = [tuple(r) for r in chunk_rows(df, "text", RecursiveChunker(ChunkingOptions(5))).orderBy("id", "chunk").collect()]
    assert got == [(1, 0, 2, "aa bb"), (1, 1, 2, "cc"), (4, 0, 1, "x")]
    assert df.columns == ["id", "text"]
    assert chunk_rows(df.where("false"), "text", RecursiveChunker(ChunkingOptions(5))).count() == 0


def test_sliding_window():
    assert SlidingWindowChunker(ChunkingOptions(4, 2))("abcdefg") == ["abcd", "cdef", "efg"]
    assert SlidingWindowChunker(ChunkingOptions(4, 2))("") == []
