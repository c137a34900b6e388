"""The registered queries of the core, and the SQL that checks them."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.config import EngineConfig
from ragmill.functions import text as cleaning
from ragmill.functions.embedding import HashingEmbedder, embed_column, token_place, tokens
from ragmill.functions.generation import EchoGenerator, generate_column
from ragmill.operators import prompting, rows, search
from ragmill.operators.chunking import ChunkingOptions, RecursiveChunker, SlidingWindowChunker, chunk_rows
from ragmill.plans.pipelines import Engine, chunk_documents
from ragmill.session import scratch_path, table
from ragmill.sources.collections import VectorStore
from ragmill.sources.files import HandlerRegistry, PdfHandler, TextFileHandler, default_registry

QUERIES: dict = {}
SQL: dict[str, str] = {}
CONFIG = EngineConfig()
K, THRESHOLD = CONFIG.top_k, CONFIG.threshold


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows where SQL can."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# -- vector search ------------------------------------------------------------------------------------------------------

_SQ = "list_sum(list_transform(generate_series(1, len(a.v)), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"
_COS = "1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"
_EMBEDDED = "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings"


def _topk_sql(asked: str, distance: str, where: str = "true", columns: str = "qid, vec_id, round(score, 6) + 0.0 AS score, rank") -> str:
    return f"""
        WITH e AS ({_EMBEDDED}),
        s AS (SELECT b.vec_id AS qid, a.vec_id, {distance} AS score FROM e a, e b WHERE {asked}),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score, vec_id) AS INT) AS rank FROM s)
        SELECT {columns} FROM r WHERE rank <= {K} AND {where}"""


def _first_vector(embeddings: DataFrame) -> list[float]:
    return embeddings.where("vec_id = 0").first()["embedding"]


@query(_topk_sql("b.vec_id = 0", _SQ, columns="vec_id, round(score, 6) + 0.0 AS score, rank"))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = table(spark, sf_dir, "embeddings")
    return search.similar(rows_, _first_vector(rows_), K, id_="vec_id").select(F.col("id").alias("vec_id"), (F.round("score", 6) + 0.0).alias("score"), "rank")


@query(_topk_sql("b.vec_id = 0", _SQ, f"score >= {THRESHOLD}", "vec_id, round(score, 6) + 0.0 AS score, rank"))
def vector_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = table(spark, sf_dir, "embeddings")
    hits = search.similar(rows_, _first_vector(rows_), K, id_="vec_id").where(search.at_least(THRESHOLD))
    return hits.select(F.col("id").alias("vec_id"), (F.round("score", 6) + 0.0).alias("score"), "rank")


def _batch(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    rows_ = table(spark, sf_dir, "embeddings")
    hits = search.similar_batch(rows_, rows_.where("vec_id % 20 = 0"), K, metric, id_="vec_id", qid="vec_id")
    return hits.select("qid", F.col("id").alias("vec_id"), (F.round("score", 6) + 0.0).alias("score"), "rank")


@query(_topk_sql("b.vec_id % 20 = 0", _SQ))
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, "sqeuclidean")


@query(_topk_sql("b.vec_id % 20 = 0", _COS))
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, "cosine")


@query(_topk_sql("b.vec_id % 20 = 0", "1 - list_dot_product(a.v, b.v)"))
def vector_topk_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, "ip")


@query(f"SELECT hit_no, qid, id, coalesce(content, '') AS content, coalesce(score, 0) AS score FROM hits WHERE coalesce(score, 0) >= {THRESHOLD}")
def search_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "hits").where(search.at_least(THRESHOLD))
    return search.as_results(hits).select("hit_no", "qid", "id", "content", "score")


@query("SELECT hit_no, coalesce(content, '') AS content, metadata.source AS source, coalesce(metadata.page, 0) AS page, coalesce(score, 0) AS score FROM hits")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.as_results(table(spark, sf_dir, "hits"))
    return hits.select("hit_no", "content", F.col("metadata.source").alias("source"), F.coalesce("metadata.page", F.lit(0)).alias("page"), "score")


@query("""
    WITH o AS (SELECT coalesce(id, '') AS id, text, row_number() OVER (PARTITION BY coalesce(id, '') ORDER BY text DESC NULLS LAST) AS i FROM vectors),
    n AS (SELECT coalesce(id, '') AS id, text, row_number() OVER (PARTITION BY coalesce(id, '') ORDER BY text DESC NULLS LAST) AS i FROM incoming_items)
    SELECT id, text FROM n WHERE i = 1 UNION ALL SELECT id, text FROM o WHERE i = 1 AND id NOT IN (SELECT id FROM n)""")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = VectorStore(spark, scratch_path(spark, "store"))
    store.upsert(table(spark, sf_dir, "vectors"))
    store.upsert(table(spark, sf_dir, "incoming_items"))
    return store.get().select("id", "text")


# -- cleaning -----------------------------------------------------------------------------------------------------------

_WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_DASH = "[-–—]"


def _replaced(column: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        column = f"regexp_replace({column}, '{pattern}', '{to}', 'g')"
    return column


_PAGES = (
    (f"(?im)^{_WS}*Page{_WS}+[0-9]+({_WS}+of{_WS}+[0-9]+)?{_WS}*$", ""),
    (f"(?m)^{_WS}*[0-9]+({_WS}+of{_WS}+[0-9]+)?{_WS}*$", ""),
    (f"(?m)^{_WS}*{_DASH}+{_WS}*[0-9]+{_WS}+of{_WS}+[0-9]+{_WS}*{_DASH}+{_WS}*$", ""),
    (f"(?m)^{_WS}*{_DASH}+{_WS}*[0-9]+{_WS}*{_DASH}+{_WS}*$", ""),
)
_LEADERS = (rf"(?m){_WS}(?:\.{{3,}}|·{{2,}}|{_DASH}{{2,}}){_WS}*[0-9]+{_WS}*$", "")
_NUMBERED = (rf"(?m)^([0-9]+(?:\.[0-9]+)*{_WS}+[^\n\r]+?)(?:{_WS}\.{{3,}}{_WS}*[0-9]+){_WS}*$", r"\1")
_DOTS = (r"(?m)^[^\n\r]{20,}\.{3}[^\n\r]*\.{3}[^\n\r]*$", "")
_HEADERS = (r"(?im)^(?:Company Name|Document Title|Confidential)[^\n\r]*", "")
#: A run of line feeds loses its last one to a blank unless it is a single one behind a stop.
_BREAKS = ((r"([.!?:])\n", "\\1\uf8fe"), (r"(\n*)\n", r"\1 "), ("\uf8fe", "\n"))


def _handler_stage(spark: SparkSession, sf_dir: str, *stages) -> DataFrame:
    text = F.coalesce("content", F.lit(""))
    for stage in stages:
        text = stage(text)
    return table(spark, sf_dir, "handler_docs").select("rec_no", text.alias("text"))


def _handler_sql(*steps: tuple[str, str]) -> str:
    return f"SELECT rec_no, {_replaced("coalesce(content, '')", *steps)} AS text FROM handler_docs"


@query(_handler_sql(*_PAGES))
def clean_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handler_stage(spark, sf_dir, cleaning.remove_page_numbers)


@query(_handler_sql(_LEADERS, _NUMBERED))
def clean_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handler_stage(spark, sf_dir, cleaning.clean_toc_leaders, cleaning.clean_numbered_toc)


@query(_handler_sql(_DOTS))
def clean_leader_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handler_stage(spark, sf_dir, cleaning.remove_leader_dot_lines)


@query(_handler_sql(_HEADERS))
def clean_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handler_stage(spark, sf_dir, cleaning.remove_headers_footers)


@query(f"SELECT doc_id, {_replaced("coalesce(text, '')", *_BREAKS, (r'\n{3,}', chr(10) * 2))} AS text FROM documents")
def clean_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = cleaning.normalize_paragraphs(cleaning.fix_line_breaks(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query("""
    WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
    SELECT doc_id, array_to_string(list_filter(x, lambda v, i: i = 1 OR v = '' OR v <> x[i - 1] OR contains(v, chr(13))), chr(10)) AS text FROM l""")
def clean_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = cleaning.remove_duplicate_lines(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query()
def clean_dedup_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = cleaning.remove_duplicate_paragraphs(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(f"SELECT doc_id, {_replaced("coalesce(text, '')", (f'^{_WS}+|{_WS}+$', ''))} AS text FROM documents")
def clean_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.trim(F.coalesce("text", F.lit(""))).alias("text"))


@query()
def clean_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.clean(F.col("text")).alias("text"))


# -- chunking -----------------------------------------------------------------------------------------------------------

_SIZE = CONFIG.chunk_size
_SLICED = "list_transform(generate_series(0, (len({0}) - 1) // %d), lambda k: substr({0}, CAST(k * %d + 1 AS BIGINT), %d))" % (_SIZE, _SIZE, _SIZE)
#: Greedy packing of a text of one line: parts start at each blank; a part of the size or more is sliced.
_CHUNKS = f"""
    t AS (SELECT key, string_split(text, ' ') AS w, text FROM t0 WHERE text <> ''),
    p AS (SELECT key, text, list_filter(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN x ELSE ' ' || x END), lambda x: x <> '') AS parts FROM t),
    f AS (SELECT key, CASE WHEN NOT contains(text, ' ') THEN {_SLICED.format('text')} ELSE
        (SELECT list_append(s.o, s.c) FROM (SELECT list_reduce(parts, lambda a, x:
            CASE WHEN len(x) >= {_SIZE} THEN {{'o': list_concat(list_append(a.o, a.c), {_SLICED.format('x')}), 'c': ''}}
                 WHEN len(a.c) + len(x) > {_SIZE} THEN {{'o': list_append(a.o, a.c), 'c': x}}
                 ELSE {{'o': a.o, 'c': a.c || x}} END, {{'o': CAST([] AS VARCHAR[]), 'c': ''}}) AS s)) END AS c FROM p),
    g AS (SELECT key, list_filter(list_transform(c, lambda x: {_replaced('x', (f'^{_WS}+|{_WS}+$', ''))}), lambda x: x <> '') AS c FROM f)"""
_ONE_LINE = "replace(coalesce(text, ''), chr(10), ' ')"


def _one_line(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " ")


@query(f"WITH t0 AS (SELECT doc_id AS key, {_ONE_LINE} AS text FROM documents), {_CHUNKS} SELECT key AS doc_id, CAST(generate_subscripts(c, 1) - 1 AS INT) AS chunk, CAST(len(c) AS INT) AS \"totalChunks\", unnest(c) AS content FROM g")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _one_line(F.col("text")).alias("text"))
    return chunk_rows(docs, "text", RecursiveChunker(ChunkingOptions(_SIZE)))


@query()
def chunk_recursive_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "handler_docs").select("rec_no", F.col("content").alias("text"))
    return chunk_rows(docs, "text", RecursiveChunker(ChunkingOptions(500, 50)))


@query("SELECT doc_id, CAST(i // 350 AS INT) AS chunk, CAST(len(s) AS INT) AS \"totalChunks\", substr(text, i + 1, 400) AS content FROM (SELECT doc_id, text, s, unnest(s) AS i FROM (SELECT doc_id, text, range(0, greatest(1, len(text) - 50), 350) AS s FROM documents WHERE text <> ''))")
def chunk_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", SlidingWindowChunker(ChunkingOptions(400, 50)))


# -- files, metadata, questions -----------------------------------------------------------------------------------------


@query("SELECT rec_no, coalesce(h.metadata.source, f.originalname) AS source, coalesce(h.metadata.mimeType, f.mimetype) AS mime_type, coalesce(h.metadata.page, 0) AS page FROM handler_docs h LEFT JOIN files f USING (file_no)")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").select("file_no", "originalname", "mimetype")
    both = table(spark, sf_dir, "handler_docs").join(files, "file_no", "left")
    merged = both.select("rec_no", rows.merge_metadata(F.col("originalname"), F.col("mimetype"), F.col("metadata")).alias("m"))
    return merged.select("rec_no", F.col("m.source").alias("source"), F.col("m.mimeType").alias("mime_type"), F.coalesce("m.page", F.lit(0)).alias("page"))


def _as_pdf(batches):
    """Texts as PDF files with a page for every 2,000 characters, each line shown by itself."""
    for batch in batches:
        files = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            pages, out = [text[i : i + 2_000] for i in range(0, max(1, len(text)), 2_000)], [b"%PDF-1.4"]
            for i, page in enumerate(pages):
                shown = b" T* ".join(b"<feff%s> Tj" % line.encode("utf-16-be").hex().encode() for line in page.split("\n"))
                body = zlib.compress(b"BT " + shown + b" ET")
                out.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj" % (10 + 2 * i, 11 + 2 * i))
                out.append(b"%d 0 obj << /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj" % (11 + 2 * i, len(body), body))
            kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
            out.append(b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [%s] >> endobj trailer << /Root 1 0 R >>" % kids)
            files.append(b"\n".join(out))
        kept = batch.select(["doc_id"]).columns
        yield pa.RecordBatch.from_arrays([*kept, pa.array(["f"] * len(files)), pa.array(["application/pdf"] * len(files)), pa.array(files, pa.binary())], names=["doc_id", "originalname", "mimetype", "buffer"])


_PDF_TEXT = "regexp_replace(regexp_replace({0}, '\n{{2,}}', chr(10), 'g'), '^\n+|\n+$', '', 'g')"


@query(f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    p AS (SELECT doc_id, text, unnest(range(0, greatest(1, len(text)), 2000)) AS i FROM t)
    SELECT doc_id, CAST(i // 2000 + 1 AS INT) AS page, CAST(greatest(1, ceil(len(text) / 2000)) AS INT) AS total_pages, {_PDF_TEXT.format('substr(text, i + 1, 2000)')} AS content FROM p""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as PDF files, read page by page."""
    files = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_as_pdf, "doc_id bigint, originalname string, mimetype string, buffer binary")
    docs = HandlerRegistry({"application/pdf": PdfHandler(cleaner=lambda c: c)}).handle(files)
    return docs.select("doc_id", F.col("metadata.page").alias("page"), F.col("metadata.totalPages").alias("total_pages"), "content")


@query(f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    p AS (SELECT doc_id, unnest(range(0, greatest(1, len(text)), 2000)) AS i, text FROM t)
    SELECT doc_id, CAST(count(*) AS INT) AS total_pages, string_agg({_PDF_TEXT.format('substr(text, i + 1, 2000)')}, chr(10) || chr(10) ORDER BY i) AS content FROM p GROUP BY doc_id""")
def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as PDF files, read as one text each."""
    files = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_as_pdf, "doc_id bigint, originalname string, mimetype string, buffer binary")
    docs = HandlerRegistry({"application/pdf": PdfHandler(mode="file", cleaner=lambda c: c)}).handle(files)
    return docs.select("doc_id", F.col("metadata.totalPages").alias("total_pages"), "content")


def _no_pages(data: bytes) -> list[str]:
    return [""]


@query("SELECT file_no, CASE mimetype WHEN 'text/plain' THEN 'text' ELSE mimetype END AS mime_type FROM files WHERE mimetype IN ('text/plain', 'application/pdf')")
def mime_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of a supported type through its handler; the uploads hold only first bytes, so PDF pages are stubbed."""
    registry = HandlerRegistry({"text/plain": TextFileHandler(), "application/pdf": lambda params: PdfHandler(_no_pages)})
    files = table(spark, sf_dir, "files").where(F.col("mimetype").isin(list(registry.handlers)))
    docs = registry.handle(files)
    return docs.select("file_no", rows.merge_metadata(F.col("originalname"), F.col("mimetype"), F.col("metadata"))["mimeType"].alias("mime_type"))


@query("SELECT DISTINCT mimetype FROM files WHERE mimetype IS NULL OR mimetype NOT IN ('text/plain', 'application/pdf')")
def mime_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default_registry().unsupported(table(spark, sf_dir, "files"))


@query()
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("file_no", cleaning.decode_utf8(F.col("buffer")).alias("text"))


@query("SELECT file_no, decode(buffer) AS text FROM files WHERE TRY(decode(buffer)) IS NOT NULL")
def decode_text_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uploads whose bytes are UTF-8 throughout, as text."""
    files = table(spark, sf_dir, "files").where(F.is_valid_utf8(F.col("buffer").cast("string")))
    return files.select("file_no", cleaning.decode_utf8(F.col("buffer")).alias("text"))


@query("SELECT qid, query FROM questions WHERE query IS NOT NULL AND query <> ''")
def questions_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "questions").where(rows.is_asked(F.col("query"))).select("qid", "query")


# -- embedding ----------------------------------------------------------------------------------------------------------


@query("""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
    p AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS INT) AS dim, CASE WHEN CAST('0x' || substr(md5(w), 9, 1) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM t),
    s AS (SELECT doc_id, dim, sum(CAST(sign AS DOUBLE)) AS v FROM p GROUP BY doc_id, dim)
    SELECT doc_id, dim, round(CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 6) AS value FROM s WHERE v <> 0""")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embed_column(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", HashingEmbedder())
    return vectors.select("doc_id", F.posexplode("embedding").alias("dim", "v")).where("v <> 0").select("doc_id", "dim", F.round(F.col("v").cast("double"), 6).alias("value"))


@query(SQL["hash_embed"].replace("round(CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 6) AS value", "v AS value"))
def hash_embed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashing embedder's sums before scaling, in generated code only: tokens are rows before anything is computed of them."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("w")).where("w <> ''")
    dim, sign = token_place(F.col("w"))
    placed = words.select("doc_id", dim.alias("dim"), sign.alias("sign"))
    return placed.groupBy("doc_id", "dim").agg(F.sum("sign").alias("value")).where("value <> 0")


# -- prompts and whole pipelines ----------------------------------------------------------------------------------------

_CONTEXTS = f"""
    h AS (SELECT qid, coalesce(content, '') AS c, row_number() OVER (PARTITION BY qid ORDER BY rank_no, hit_no) AS i FROM hits WHERE coalesce(score, 0) >= {THRESHOLD}),
    ctx AS (SELECT qid, string_agg('[' || i || '] ' || c, chr(10) || chr(10) ORDER BY i) AS context FROM h GROUP BY qid)"""
_NO_CONTEXT = "'" + prompting.NO_CONTEXT.replace("'", "''") + "'"
_USER = f"""CASE WHEN coalesce(context, '') = '' THEN 'Question: ' || query || {_NO_CONTEXT}
    ELSE 'Context: ' || context || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Answer:' END"""


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "hits").where(search.at_least(THRESHOLD)).withColumn("rank", F.struct("rank_no", "hit_no"))
    return prompting.build_context(hits)


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "questions").where(rows.is_asked(F.col("query")))
    content = prompting.build_content(F.col("context"), F.col("query"))
    return asked.join(_contexts(spark, sf_dir), "qid", "left").select("qid", "context", prompting.build_prompt(content, "stub").alias("prompt"))


@query(f"WITH {_CONTEXTS} SELECT qid, context FROM ctx")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir)


@query(f"""WITH {_CONTEXTS}, q AS (SELECT qid, {_USER} AS u FROM questions LEFT JOIN ctx USING (qid) WHERE query <> '')
    SELECT qid, 'stub' AS model, 'system' AS role, '{prompting.SYSTEM.replace("'", "''")}' AS content FROM q UNION ALL SELECT qid, 'stub', 'user', u FROM q""")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("qid", F.col("prompt.model").alias("model"), F.explode("prompt.messages").alias("m")).select("qid", "model", "m.role", "m.content")


@query("SELECT opt_no, CASE WHEN coalesce(overlap, 0) = 0 THEN 512 ELSE overlap END AS max_tokens FROM chunk_options")
def prompt_max_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit in a prompt's context, for limits that are given, missing and 0."""
    context = prompting.prompt_context(F.lit("?"), F.lit(None).cast("string"), F.col("overlap"))
    return table(spark, sf_dir, "chunk_options").select("opt_no", context.alias("c")).select("opt_no", F.col("c.maxTokens").alias("max_tokens"))


@query(f"WITH {_CONTEXTS} SELECT qid, CASE WHEN context IS NULL THEN '' ELSE 'stub: ' || {_USER} END AS response FROM questions LEFT JOIN ctx USING (qid) WHERE query <> ''")
def rag_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = _prompts(spark, sf_dir).select("qid", F.when(F.col("context").isNotNull(), F.col("prompt")).alias("prompt"))
    return generate_column(prompts, "prompt", EchoGenerator()).select("qid", F.coalesce("response", F.lit("")).alias("response"))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as uploaded text files."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("source").alias("originalname"), F.lit("text/plain").alias("mimetype"), F.col("text").cast("binary").alias("buffer"))


@query(f"WITH t0 AS (SELECT {{'d': doc_id, 's': source}} AS key, {_ONE_LINE} AS text FROM documents), {_CHUNKS} SELECT key.s AS source, 'text' AS mime_type, CAST(generate_subscripts(c, 1) - 1 AS INT) AS chunk, CAST(len(c) AS INT) AS total_chunks, unnest(c) AS text FROM g")
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest up to the write, with a cleaner that only takes line breaks out."""
    registry = HandlerRegistry({"text/plain": TextFileHandler(_one_line)})
    chunks = chunk_documents(registry.handle(_uploads(spark, sf_dir).drop("doc_id")), RecursiveChunker(ChunkingOptions(_SIZE)), "content")
    return chunks.select(F.col("metadata.source").alias("source"), F.col("metadata.mimeType").alias("mime_type"), F.col("metadata.chunk").alias("chunk"), F.col("metadata.totalChunks").alias("total_chunks"), F.col("content").alias("text"))


@query()
def rag_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything: documents are ingested into a new collection, then all questions are answered from it."""
    engine = Engine(spark, scratch_path(spark, "store"), CONFIG, id_mode="content")
    engine.ingest(_uploads(spark, sf_dir).drop("doc_id"))
    return engine.answer(table(spark, sf_dir, "questions"))


_GRID = "SELECT {0}, list(coalesce(x, 0) ORDER BY d)::DOUBLE[] AS v FROM (SELECT {0}, unnest(range(64)) AS d FROM {1}) LEFT JOIN {1}_x USING ({0}, d) GROUP BY {0}"


def _hashed_sql(key: str, source: str, text: str) -> str:
    """Tables {source}_x and {source}_v: hashing embeddings of a table, by component and as vectors."""
    return f"""
        {source}_p AS (SELECT {key}, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS INT) AS d, CASE WHEN CAST('0x' || substr(md5(w), 9, 1) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign
            FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {source})),
        {source}_s AS (SELECT {key}, d, sum(CAST(sign AS DOUBLE)) AS v FROM {source}_p GROUP BY {key}, d),
        {source}_x AS (SELECT {key}, d, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS x FROM {source}_s WHERE v <> 0),
        {source}_v AS ({_GRID.format(key, source)})"""


@query(f"""
    WITH t0 AS (SELECT {{'d': doc_id, 's': source}} AS key, {_ONE_LINE} AS text FROM documents), {_CHUNKS},
    c0 AS (SELECT key.s AS source, CAST(generate_subscripts(c, 1) - 1 AS INT) AS chunk, unnest(c) AS text FROM g),
    i AS (SELECT DISTINCT 'chunk-' || sha256(coalesce(source, chr(30)) || chr(31) || chr(30) || chr(31) || chunk || chr(31) || text) AS id, text FROM c0),
    q AS (SELECT qid, query FROM questions WHERE query <> ''), {_hashed_sql('id', 'i', 'text')}, {_hashed_sql('qid', 'q', 'query')},
    r AS (SELECT b.qid, a.id, {_SQ} AS score, row_number() OVER (PARTITION BY b.qid ORDER BY {_SQ}, a.id) AS n FROM i_v a, q_v b),
    h AS (SELECT qid, id, n, row_number() OVER (PARTITION BY qid ORDER BY n) AS k FROM r WHERE n <= {K} AND score >= {THRESHOLD}),
    ctx AS (SELECT qid, string_agg('[' || k || '] ' || text, chr(10) || chr(10) ORDER BY k) AS context FROM h JOIN i USING (id) GROUP BY qid)
    SELECT qid, CASE WHEN context IS NULL THEN '' ELSE ': ' || {_USER} END AS response FROM q LEFT JOIN ctx USING (qid)""")
def rag_query_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything, as ``rag_query``, with a cleaner that only takes line breaks out: ingest, embed, upsert, search, answer."""
    registry = HandlerRegistry({"text/plain": TextFileHandler(_one_line)})
    engine = Engine(spark, scratch_path(spark, "store"), CONFIG, registry, id_mode="content")
    engine.ingest(_uploads(spark, sf_dir).drop("doc_id"))
    return engine.answer(table(spark, sf_dir, "questions"))
