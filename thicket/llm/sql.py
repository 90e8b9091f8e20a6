"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def decontamination(documents: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM {documents}),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, least(10, len(w)) AS size, list_slice(w, s, s + least(10, len(w)) - 1) AS gram
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, size, s, list_slice(w, s, s + size - 1) AS gram
       FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s
             FROM d CROSS JOIN (SELECT DISTINCT size FROM iw) z WHERE len(w) >= size)),
m AS (SELECT doc_id, item_id, s, dw.size FROM dw JOIN iw ON dw.gram = iw.gram AND dw.size = iw.size),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM m) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def merkle_fixity() -> str:
    return """
WITH r AS (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS a FROM pages),
o AS (SELECT page_id, a, CAST(strlen(a) AS BIGINT) AS length, CAST(sum(strlen(a)) OVER (ORDER BY page_id) - strlen(a) AS BIGINT) AS place FROM r),
p AS (SELECT *, place // 67108864 AS archive, place - min(place) OVER (PARTITION BY place // 67108864) AS "offset" FROM o),
w AS (SELECT *, max("offset" + length) OVER (PARTITION BY archive) AS whole,
      CASE WHEN page_id % 101 = 1 THEN substring(a, 1, 40) || repeat(chr(0), greatest(strlen(a) - strlen(substring(a, 1, 40)), 0)) WHEN page_id % 97 = 0 THEN 'w' || substring(a, 2) ELSE a END AS b FROM p),
f AS (SELECT *, archive % 2 = 0 AND ("offset" + length) * 128 > whole * 127 AS lost FROM w)
SELECT archive, "offset", length, page_id, sha256(a) AS expected, CASE WHEN NOT lost THEN sha256(b) END AS found, CASE WHEN lost THEN 'missing' ELSE 'altered' END AS status
FROM f WHERE lost OR b <> a
"""


#: Vectors and planted copies, for Spark and DuckDB alike.
PLANTED = """
SELECT vec_id, label, e AS embedding FROM (SELECT vec_id, label, {list} AS e FROM embeddings) a
UNION ALL SELECT vec_id + 1000000000, label, {map3} FROM (SELECT vec_id, label, {list} AS e FROM embeddings) b WHERE vec_id % 3 = 0
UNION ALL SELECT vec_id + 2000000000, label, {map5} FROM (SELECT vec_id, label, {list} AS e FROM embeddings) c WHERE vec_id % 5 = 0
UNION ALL SELECT vec_id + 3000000000, label, {map7} FROM (SELECT vec_id, label, {list} AS e FROM embeddings) d WHERE vec_id % 7 = 0
"""


def planted(spark: bool) -> str:
    """Component i, from 0, is scaled by 1 or 1.06 by turns (a cosine of 0.9992 or nearly so), by 1 or 2 (0.95), or by 2.5."""
    if spark:
        turn = {k: f"transform(e, (x, i) -> x * (1D + (i % 2) * {by}D))" for k, by in (("map3", 0.06), ("map5", 1.0))}
        return PLANTED.format(list="CAST(embedding AS ARRAY<DOUBLE>)", map7="transform(e, x -> x * 2.5D)", **turn)
    turn = {k: f"list_transform(e, lambda x, i: x * (1.0::DOUBLE + ((i + 1) % 2) * {by}::DOUBLE))" for k, by in (("map3", 0.06), ("map5", 1.0))}
    return PLANTED.format(list="CAST(embedding AS DOUBLE[])", map7="list_transform(e, lambda x: x * 2.5::DOUBLE)", **turn)


def sorted_projections(source: str = "embeddings") -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM {source}),
s AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links,
       coalesce(c.component, v.vec_id) AS component_id, coalesce(c.component, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN (SELECT node, min(seen) AS component FROM r GROUP BY node) c ON c.node = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination(), "op2_merkle_fixity": merkle_fixity(), "op7_sorted_projections": sorted_projections(), "planted_near_vectors": sorted_projections(f"({planted(False)}) planted")}
