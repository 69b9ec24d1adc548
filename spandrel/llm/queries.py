"""The registered queries of this package and their SQL."""

from __future__ import annotations

from spandrel.llm import bpe, descent, fingerprints, jaccard, language, neighbours, packing, prefixes, sanitise, sharding, suffixes, toxicity, whitening

QUERIES = {
    "op1_scoring_segments": toxicity.op1_scoring_segments,
    "op2_weighted_hash_tree": sharding.op2_weighted_hash_tree,
    "op3_sum_of_squares": packing.op3_sum_of_squares,
    "op4_deep_shallow": suffixes.op4_deep_shallow,
    "op5_projected_kd_tree": neighbours.op5_projected_kd_tree,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_nn_descent": descent.op7_nn_descent,
    "op8_fingerprint_index": fingerprints.op8_fingerprint_index,
    "op9_byte_recurrent_language": language.op9_byte_recurrent_language,
    "op10_grouped_prefix_join": jaccard.op10_grouped_prefix_join,
    "op11_disclosure_sanitiser": sanitise.op11_disclosure_sanitiser,
    "op12_level_order_tries": prefixes.op12_level_order_tries,
    "op13_digit_slice_whitening": whitening.op13_digit_slice_whitening,
}

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

#: Every string of 50 bytes, as hexadecimal digits, with the least document that it starts in.
_REPEATS = f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - {suffixes.LENGTH - 1}, 0))) AS i FROM t),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * suffixes.LENGTH}) AS k FROM s),
least AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT w.doc_id, unnest(range(w.i, w.i + {suffixes.LENGTH})) AS p FROM w JOIN least USING (k) WHERE first < w.doc_id),
spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (new) AS n_spans, list(p) AS ps FROM (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 1, true) AS new FROM gone) GROUP BY doc_id),
bytes AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS b, unnest(range(0, len(h) // 2)) AS p FROM t WHERE doc_id IN (SELECT doc_id FROM spans)),
kept AS (SELECT b.doc_id, string_agg(b.b, '' ORDER BY b.p) AS h FROM bytes b LEFT JOIN gone g ON g.doc_id = b.doc_id AND g.p = b.p WHERE g.p IS NULL GROUP BY b.doc_id)
SELECT t.doc_id, (len(t.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN spans.doc_id IS NULL THEN t.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM t LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: All pairs of vectors with their cosine, and what is reachable over links.
_NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

#: Every window of words, and how often it stands.
_PASSAGES = f"""
WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {fingerprints.LENGTH - 2}, 1))) AS i FROM t),
w AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {fingerprints.LENGTH - 1}), ' ') AS k FROM s),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT w.doc_id, unnest(range(w.i, w.i + {fingerprints.LENGTH})) AS p FROM w JOIN again USING (k)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM t),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS text FROM words x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p WHERE g.p IS NULL GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Shingle sets, their overlaps, and what is reachable over links.
_LINKS = f"""
WITH RECURSIVE t AS (SELECT doc_id, list_transform({_WORDS.format("coalesce(text, '')")}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' ')) END) AS k FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {jaccard.PER_CENT} * (x.n + y.n - common)),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, t.doc_id) AS component_id FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = t.doc_id
"""

SQL = {
    "op2_weighted_hash_tree": sharding.SQL,
    "op4_deep_shallow": _REPEATS,
    "op7_nn_descent": _NEAR_VECTORS,
    "op8_fingerprint_index": _PASSAGES,
    "op10_grouped_prefix_join": _LINKS,
    "op12_level_order_tries": prefixes.SQL,
}
