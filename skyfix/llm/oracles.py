"""DuckDB SQL for the queries whose contracts SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str, text: str = "text") -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


OP4 = rf"""
WITH d AS (SELECT doc_id, {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
b AS (SELECT item_id, {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) x),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) l WHERE len(w) >= n) y),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) z GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) u GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

OP6 = rf"""
WITH d AS (SELECT doc_id, {_words(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50) y),
h AS (SELECT win, min(doc_id) AS first FROM x GROUP BY win HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, i, doc_id = first AS kept FROM x JOIN h USING (win)),
g AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id, kept ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, kept ORDER BY i) > 50 THEN 1 ELSE 0 END AS gap FROM m) z)
SELECT doc_id, min(i) - 1 AS start_word, max(i) + 49 AS end_word, max(i) - min(i) + 50 AS n_words, kept FROM g GROUP BY doc_id, kept, run"""

_FIVE = "cast('0x' || substr(upper(sha1(coalesce(html, ''))), 5 * ((i - 1) // 4) + 1, 5) AS bigint)"
OP7 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, array_to_string(list_transform(range(1, 33), lambda i: substr('{UPPER}234567', cast(({_FIVE} >> (15 - 5 * ((i - 1) % 4))) & 31 AS bigint) + 1, 1)), '') AS payload_digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p"""

_ESCAPED = r"replace(replace(replace({}, '\', '\e'), '<', '\l'), '[', '\s')"
OP8 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', NULL UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL),
f AS (SELECT *, length({_ESCAPED.format('text')}) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 8 + length(replace({_ESCAPED.format('role')}, '>', '\g')) END AS size FROM c),
g AS (SELECT *, sum(size) OVER (PARTITION BY conv_id, own ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn DESC, role DESC, text DESC) AS back FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256, cast(sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END) AS bigint) AS formatted_chars FROM g GROUP BY conv_id, own"""

OP11 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
n AS (SELECT x, count(*) AS n FROM b GROUP BY x),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.vec_id)
SELECT r.vec_id, coalesce(max(n.n), 0) AS n_links, min(root) AS component_id, min(root) = r.vec_id AS kept FROM r LEFT JOIN n ON n.x = r.vec_id GROUP BY r.vec_id"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, f),
u AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM u a, u b, u c, u d, u e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, i, substr(o, i, 1) AS x, substr(o, 1, i - 1) AS before FROM (SELECT o, unnest(range(1, 6)) AS i FROM p) q),
g AS (SELECT part, o, i, x, n, good, toxic, f, contains(f, x) AS hit, length(translate(f, before, '')) < length(f) AS gone FROM c, s),
h AS (SELECT part, o, i, x, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f = x THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM g GROUP BY part, o, i, x)
SELECT part, o AS filter_order, CAST(i AS integer) AS step, CAST(kept AS bigint) AS kept, CAST(removed AS bigint) AS removed, CAST(redundant AS bigint) AS redundant, CAST(unique_fails AS bigint) AS unique_fails, CAST(good_lost AS bigint) AS good_lost, CAST(toxic_lost AS bigint) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS bigint) AS shapley FROM h"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || doc_id) AS h FROM documents),
r AS (SELECT doc_id, t, w, len(w) AS n, [cast('0x' || substr(h, 8 * i + 1, 8) AS bigint) for i in [0, 1, 2, 3]] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
x AS (SELECT doc_id, n, t, form, coalesce(array_to_string(w[1 : a], ''), '') AS p, coalesce(array_to_string(w[a + 1 : b], ''), '') AS m, coalesce(array_to_string(w[b + 1 : n], ''), '') AS s FROM c)
SELECT doc_id, cast(n AS bigint) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM x"""

ORACLES = {"op4_decontamination": OP4, "op5_ngram_join": OP5, "op6_suffix_dedup": OP6, "op7_warc": OP7, "op8_chat": OP8, "op11_cover_tree": OP11, "op12_filter_audit": OP12, "op13_fill_in_middle": OP13}
