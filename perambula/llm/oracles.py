"""DuckDB SQL for the queries that it can express over whole tables in seconds at small scales."""

from __future__ import annotations

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP3 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 n AS (SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
 f AS (SELECT s, min(doc_id) AS least FROM n GROUP BY 1), h AS (SELECT doc_id, i FROM n JOIN f USING (s) WHERE least < doc_id),
 g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h), c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN g USING (doc_id, p) GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

OP5 = """SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
 CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id < max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))"""

# Bytes are pairs of hexadecimal digits; strings of 50 are cut from pieces of 549, as long texts are slow to index.
OP6 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 c AS (SELECT doc_id, j, x[1000*j+1:1000*j+1098] AS y FROM (SELECT doc_id, x, unnest(range(0, CAST(ceil((len(x)//2 - 49) / 500) AS BIGINT))) AS j FROM d WHERE len(x) >= 100)),
 n AS (SELECT doc_id, 500*j + i AS i, y[2*i+1:2*i+100] AS s FROM (SELECT doc_id, j, y, unnest(range(0, len(y)//2 - 49)) AS i FROM c)),
 f AS (SELECT s, min(doc_id) AS least FROM n GROUP BY 1), h AS (SELECT doc_id, i FROM n JOIN f USING (s) WHERE least < doc_id),
 o AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM h),
 r AS (SELECT doc_id, i, sum(CASE WHEN b IS NULL OR i > b + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
 s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, run),
 p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM s),
 q AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, max(z) AS last, string_agg(x[2*b+1:2*a], '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY 1)
 SELECT doc_id, CAST(len(x)//2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE kept || x[2*last+1:] END)) AS kept_sha256 FROM d LEFT JOIN q USING (doc_id)"""

OP7 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
 r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node AND r.root < l.b),
 c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
 SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id"""

QUALITY_BASE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
 n AS (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
 m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS times FROM n),
 r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM m WHERE times > 1) GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN r USING (doc_id)"""
