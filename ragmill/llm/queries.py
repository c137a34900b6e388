"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.llm import boilerplate, history, knn, lookalikes, neardup, packing, pages, splitting, tokens
from ragmill.session import table


def _texts(spark, sf_dir):
    """The texts of vectors and the contents of handler_docs as one table; keys of the first are even, of the second odd."""
    v, h = table(spark, sf_dir, "vectors"), table(spark, sf_dir, "handler_docs")
    v = v.select((F.col("item_no") * 2).alias("key"), F.lit("vectors").alias("table_name"), "text")
    return v.unionByName(h.select((F.col("rec_no") * 2 + 1).alias("key"), F.lit("handler_docs").alias("table_name"), F.col("content").alias("text")))


def _own_key(column):
    return F.shiftright(column, 1)


def p1_found(spark, sf_dir):
    pairs = neardup.near_pairs(_texts(spark, sf_dir), "key", "text", "table_name")
    return pairs.select(F.col("within").alias("table_name"), _own_key("key_a").alias("key_a"), _own_key("key_b").alias("key_b"))


def p1_groups(spark, sf_dir):
    out = neardup.groups(_texts(spark, sf_dir), "key", "text", "table_name")
    return out.select(F.col("within").alias("table_name"), _own_key("key").alias("key"), _own_key("group_key").alias("group_key"), "links")


def p2_found(spark, sf_dir):
    return pages.found_lines(table(spark, sf_dir, "handler_docs"), "rec_no").withColumnRenamed("key", "rec_no")


def p2_text(spark, sf_dir):
    return pages.paragraphs(table(spark, sf_dir, "handler_docs"), "rec_no").withColumnRenamed("key", "rec_no")


def p3_found(spark, sf_dir):
    found = boilerplate.found_lines(table(spark, sf_dir, "handler_docs"), table(spark, sf_dir, "files"), "rec_no", "content")
    return found.select(F.col("key").alias("rec_no"), "line_no")


def p3_cleaned(spark, sf_dir):
    out = boilerplate.cleaned(table(spark, sf_dir, "handler_docs"), table(spark, sf_dir, "files"), "rec_no", "content")
    return out.select(F.col("key").alias("rec_no"), "content")


def p4_pieces(spark, sf_dir):
    out = splitting.split_records(table(spark, sf_dir, "handler_docs"), table(spark, sf_dir, "chunk_options"), "rec_no", "content")
    return out.withColumnRenamed("key", "rec_no")


def p4_found(spark, sf_dir):
    out = splitting.split_records(table(spark, sf_dir, "handler_docs"), table(spark, sf_dir, "chunk_options"), "rec_no", "content", only_oversized=True)
    return out.where("piece_no = 0").select(F.col("key").alias("rec_no"), "kind")


def p5_found(spark, sf_dir):
    return history.repeats(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "incoming_items"), "item_no", "in_no", "batch_no")


def p6_nearest(spark, sf_dir):
    found = knn.nearest(table(spark, sf_dir, "vectors"), "item_no", "embedding")
    return found.select(F.col("key").alias("item_no"), "neighbour", "score", "rank")


def p6_found(spark, sf_dir):
    found = knn.nearest(table(spark, sf_dir, "vectors"), "item_no", "embedding")
    return knn.mutual(found, 0.90).select(F.col("a").alias("item_a"), F.col("b").alias("item_b"))


def p7_ids(spark, sf_dir):
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_bins(spark, sf_dir):
    return packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark, sf_dir):
    # A text has a second piece exactly if it alone exceeds a container.
    return p8_bins(spark, sf_dir).where("piece_no = 1").select("doc_id")


def p9_canonical(spark, sf_dir):
    return lookalikes.canonical_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark, sf_dir):
    return lookalikes.look_alike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text", "doc_a", "doc_b")


def p9_classes(spark, sf_dir):
    return lookalikes.look_alike_classes(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_text, p3_found, p3_cleaned, p4_pieces, p4_found, p5_found, p6_nearest, p6_found, p7_ids, p8_bins, p8_found, p9_canonical, p9_classes, p9_found)}
_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WORD = r"[\p{L}\p{N}]+"


def _similar(left: str, right: str, on: str) -> str:
    """Pairs (a, b) of rows of two tables (t, k, text) whose texts have a similarity of 0.75, or are equal without words."""
    side = lambda n, x: f"""
        {n}v AS (SELECT * FROM {x} WHERE regexp_replace(text, '{_BLANK}+', '', 'g') <> ''),
        {n}o AS (SELECT t, k, w, row_number() OVER (PARTITION BY t, k, w) AS i FROM (SELECT t, k, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS w FROM {n}v)),
        {n}n AS (SELECT t, k, count(*) AS n FROM {n}o GROUP BY t, k)"""  # noqa: E731
    return f"""{side('l', left)}, {side('r', right)},
        both_ AS (SELECT a.t, a.k AS a, b.k AS b, count(*) AS c FROM lo a JOIN ro b ON a.t = b.t AND a.w = b.w AND a.i = b.i AND {on} GROUP BY ALL),
        pair AS (SELECT c.t, c.a, c.b FROM both_ c JOIN ln x ON x.t = c.t AND x.k = c.a JOIN rn y ON y.t = c.t AND y.k = c.b WHERE 4 * c.c >= 3 * (x.n + y.n - c.c)
            UNION SELECT a.t, a.k, b.k FROM lv a JOIN rv b ON a.t = b.t AND a.text = b.text AND {on})"""


_TEXTS = "x AS (SELECT 'vectors' AS t, item_no AS k, text FROM vectors UNION ALL SELECT 'handler_docs', rec_no, content FROM handler_docs)"
_SITE_LINES = rf"""
        f AS (SELECT file_no, regexp_extract(lower(replace(originalname, chr(92), '/')), '^(?:[a-z]+://)?(?:www\.)?([a-z0-9-]+(?:\.[a-z0-9-]+)+)(?::[0-9]+)?/', 1) AS site FROM files),
        r AS (SELECT rec_no, site, content FROM handler_docs JOIN f USING (file_no) WHERE site <> ''),
        n AS (SELECT site, count(*) AS n FROM r GROUP BY site),
        l AS (SELECT rec_no, site, unnest(s) AS line, generate_subscripts(s, 1) AS line_no FROM (SELECT rec_no, site, string_split(content, chr(10)) AS s FROM r)),
        k AS (SELECT rec_no, site, line, CAST(line_no AS INT) AS line_no, lower(regexp_replace(line, '(?:{_BLANK}|\p{{Nd}})+', '', 'g')) AS key FROM l),
        c AS (SELECT site, key, count(DISTINCT rec_no) AS c FROM k WHERE key <> '' GROUP BY site, key),
        d AS (SELECT rec_no, line_no FROM k JOIN c USING (site, key) JOIN n USING (site) WHERE c >= 8 AND 5 * c >= n)"""
_ID = rf"nullif(lower(regexp_replace(id, '^{_BLANK}+|{_BLANK}+$', '', 'g')), '')"
SQL: dict[str, str] = {
    "p1_found": f"WITH {_TEXTS}, {_similar('x', 'x', 'a.k < b.k')} SELECT t AS table_name, a AS key_a, b AS key_b FROM pair",
    "p1_groups": f"""
        WITH RECURSIVE {_TEXTS}, {_similar('x', 'x', 'a.k < b.k')},
        e AS (SELECT t, a, b FROM pair UNION ALL SELECT t, b, a FROM pair),
        g AS (SELECT t, k AS a, k AS b FROM lv UNION SELECT g.t, g.a, e.b FROM g JOIN e ON g.t = e.t AND g.b = e.a),
        m AS (SELECT t, k, coalesce(s, text) AS s FROM lv LEFT JOIN (SELECT t, k, string_agg(w, ' ' ORDER BY w, i) AS s FROM lo GROUP BY t, k) USING (t, k)),
        d AS (SELECT x.t, x.k, count(DISTINCT y.s) AS links FROM m x JOIN e ON e.t = x.t AND e.a = x.k JOIN m y ON y.t = e.t AND y.k = e.b WHERE y.s <> x.s GROUP BY ALL)
        SELECT g.t AS table_name, g.a AS key, min(g.b) AS group_key, any_value(coalesce(links, 0)) AS links FROM g LEFT JOIN d ON d.t = g.t AND d.k = g.a GROUP BY g.t, g.a""",
    "p3_found": f"WITH {_SITE_LINES} SELECT rec_no, line_no FROM d",
    "p3_cleaned": f"""
        WITH {_SITE_LINES}, q AS (SELECT rec_no, string_agg(line, chr(10) ORDER BY line_no) AS kept FROM k ANTI JOIN d USING (rec_no, line_no) GROUP BY rec_no)
        SELECT rec_no, CASE WHEN rec_no IN (SELECT rec_no FROM d) THEN coalesce(kept, '') ELSE content END AS content FROM handler_docs LEFT JOIN q USING (rec_no)""",
    "p4_found": rf"""
        WITH r AS (SELECT rec_no, content, coalesce("chunkSize", 1000) AS size, coalesce(overlap, 0) AS overlap FROM handler_docs LEFT JOIN chunk_options USING (opt_no))
        SELECT rec_no, CASE WHEN list_max(list_transform(regexp_split_to_array(content, '{_BLANK}+'), lambda x: len(x))) > size THEN 'forced' ELSE 'natural' END AS kind
        FROM r WHERE size >= 1 AND overlap >= 0 AND overlap < size AND len(content) > size""",
    "p5_found": f"""
        WITH RECURSIVE h AS (SELECT 0 AS t, item_no AS k, text, {_ID} AS id FROM vectors),
        n AS (SELECT 0 AS t, in_no AS k, text, {_ID} AS id, batch_no, row_number() OVER (ORDER BY batch_no NULLS FIRST, in_no) AS i FROM incoming_items),
        x AS (SELECT t, 2 * k AS k, text FROM h UNION ALL SELECT t, 2 * k + 1, text FROM n), y AS (SELECT t, 2 * k + 1 AS k, text FROM n),
        {_similar('x', 'y', 'a.k <> b.k')},
        old AS (SELECT b // 2 AS k FROM pair WHERE a % 2 = 0 UNION SELECT n.k FROM n JOIN h USING (id)),
        near AS (SELECT b // 2 AS k, a // 2 AS o FROM pair WHERE a % 2 = 1 UNION SELECT p.k, q.k FROM n p JOIN n q ON p.id = q.id AND p.k <> q.k),
        l AS (SELECT n.i, n.k, n.k IN (SELECT k FROM old) AS hit, coalesce((SELECT list(o) FROM near WHERE near.k = n.k), []) AS o FROM n),
        s AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL
            SELECT s.i + 1, CASE WHEN l.hit OR list_has_any(s.kept, l.o) THEN s.kept ELSE list_append(s.kept, l.k) END FROM s JOIN l ON l.i = s.i + 1)
        SELECT n.k AS in_no, batch_no FROM n WHERE NOT list_contains((SELECT kept FROM s ORDER BY i DESC LIMIT 1), n.k)""",
    "p6_found": """
        WITH e AS (SELECT item_no, embedding::DOUBLE[] AS v FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT a.item_no AS a, b.item_no AS b, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM e a JOIN e b ON a.item_no <> b.item_no),
        r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS i FROM s)
        SELECT x.a AS item_a, x.b AS item_b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.i <= 10 AND y.i <= 10 AND x.a < x.b AND x.c >= 0.9""",
}
