"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

A sentencepiece BPE model is serialised straight from the vocabulary file: every token's bytes are written with the
printable byte alphabet, its score is its negative rank, and normalisation is the identity. Sentencepiece then merges in
exactly the order of the ranks. Texts are cut into pre-tokens first; a pre-token never crosses the place where a blank
stands between two visible characters, so runs between such blanks are encoded once and remembered.

Defined results: a null and an empty text both have the empty list; text that looks like a special token is ordinary.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ragmill.llm.arrow import int_lists, over_batches

#: Where the public vocabularies are; a parameter of every function below.
TOKENIZER_DIR = os.environ.get("RAGMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the split pattern that belongs to the byte_bpe vocabularies.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs longer than this are not remembered, and this many runs are at most.
LONGEST_RUN, MOST_RUNS = 40, 400_000


def byte_alphabet() -> list[str]:
    """One printable character per byte: bytes that print stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, spare = [""] * 256, 0x100
    for b in shown:
        names[b] = chr(b)
    for b in range(256):
        if not names[b]:
            names[b] = chr(spare)
            spare += 1
    return names


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    pairs = []
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                pairs.append((int(rank), base64.b64decode(token)))
    pairs.sort()
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not 0..n-1")
    return [t for _, t in pairs]


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; piece id = rank + 1, piece 0 is the unknown piece it demands."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    names = byte_alphabet()
    model = pb.ModelProto()
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(names[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    spec = model.trainer_spec
    spec.model_type = pb.TrainerSpec.BPE
    spec.vocab_size = len(tokens) + 1
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = 0, -1, -1, -1
    norm = model.normalizer_spec
    norm.name = "identity"
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class Encoder:
    """Encodes and decodes with one vocabulary; keeps what runs of text encode to."""

    def __init__(self, tokens: list[bytes]):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.names = byte_alphabet()
        self.to_names = dict(enumerate(self.names))
        self.split = regex.compile(PRETOKEN).findall
        self.runs: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}

    def _pretoken(self, text: str) -> bytes:
        found = self.pretokens.get(text)
        if found is None:
            mapped = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_names)
            found = (np.asarray(self.processor.encode(mapped), dtype=np.int32) - 1).tobytes()
            if len(text) <= LONGEST_RUN:
                if len(self.pretokens) >= MOST_RUNS:
                    self.pretokens.clear()
                self.pretokens[text] = found
        return found

    def _run(self, run: str) -> bytes:
        found = b"".join(map(self._pretoken, self.split(run)))
        if len(run) <= LONGEST_RUN and not run[-1].isspace() and not (len(run) > 1 and run[1].isspace()):
            if len(self.runs) >= MOST_RUNS:
                self.runs.clear()
            self.runs[run] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids as raw int32 bytes."""
        if not text:
            return b""
        words = text.split(" ")
        runs, get, out = self.runs, self.runs.get, []
        first = True
        for word in words:
            run = word if first else " " + word
            found = get(run)
            if found is None:
                # A blank next to other white space decides together with it: cut the text as a whole.
                if not word or word[0].isspace() or word[-1].isspace():
                    return b"".join(map(self._pretoken, self.split(text)))
                found = self._run(run)
            out.append(found)
            first = False
        return b"".join(out)

    def decode_bytes(self, ids) -> bytes:
        """The bytes the ids stand for: the exact inverse also where ids are cut within a character."""
        return b"".join(self.tokens[i] for i in ids)

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary file on this machine."""
    return Encoder(read_ranks(os.path.join(tokenizer_dir, vocabulary + ".tiktoken")))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def shipped(spark: SparkSession, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Callable[[], Encoder]:
    """A maker of the encoder for tasks: the driver alone reads the file and sends its tokens, which are less than a megabyte;
    a worker process makes the encoder once."""
    tokens = spark.sparkContext.broadcast(read_ranks(os.path.join(tokenizer_dir, vocabulary + ".tiktoken")))
    name = tokenizer_dir, vocabulary

    def make() -> Encoder:
        if name not in _ENCODERS:
            _ENCODERS[name] = Encoder(tokens.value)
        return _ENCODERS[name]

    return make


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): one row per row of ``df``. No shuffle; a null or empty text has the empty list. Repeated keys repeat."""

    ready = shipped(df.sparkSession, tokenizer_dir, vocabulary)

    def make():
        enc = ready()

        def work(batch: pa.RecordBatch):
            lists = int_lists([enc.encode(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

        return work

    kind = df.schema[key].dataType.simpleString()
    return over_batches(df.select(key, text), make, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keys: list[str], text: str, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(keys..., n_tokens): like ``encode_corpus`` without handing the ids out."""

    ready = shipped(df.sparkSession, tokenizer_dir, vocabulary)

    def make():
        enc = ready()

        def work(batch: pa.RecordBatch):
            n = [len(enc.encode(t)) // 4 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keys, "n_tokens"])

        return work

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return over_batches(df.select(*keys, text), make, f"{kinds}, n_tokens bigint")


def decode_corpus(df: DataFrame, key: str, ids: str, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the inverse of ``encode_corpus``; a null list stays null, an empty list gives the empty text."""

    ready = shipped(df.sparkSession, tokenizer_dir, vocabulary)

    def make():
        enc = ready()

        def work(batch: pa.RecordBatch):
            texts = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

        return work

    kind = df.schema[key].dataType.simpleString()
    return over_batches(df.select(key, ids), make, f"`{key}` {kind}, text string")
