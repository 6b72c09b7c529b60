"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

OP1 = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY ALL)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""

OP3 = r"""
WITH d AS (SELECT doc_id, array_remove_empty FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS array_remove_empty FROM documents)),
w AS (SELECT doc_id, array_remove_empty AS words, len(array_remove_empty) AS n_words FROM d),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
iw AS (SELECT item_id, words, least(len(words), 10) AS size FROM i WHERE len(words) > 0),
g AS (SELECT DISTINCT item_id, size, array_to_string(words[s:s + size - 1], ' ') AS gram FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM iw)),
z AS (SELECT DISTINCT size FROM g),
dw AS (SELECT doc_id, size, s, array_to_string(words[s:s + size - 1], ' ') AS gram FROM (SELECT doc_id, words, size, unnest(range(1, n_words - size + 2)) AS s FROM w, z WHERE n_words >= size)),
h AS (SELECT doc_id, size, s, item_id FROM dw JOIN g USING (size, gram)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM h) GROUP BY 1),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT doc_id, n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN x USING (doc_id)
"""

OP5 = r"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM t GROUP BY source),
f AS (SELECT *, source_size * 3.0 AS cap, source_size * 3.0 / weight AS fill FROM s),
-- the level is the least at which the targets spend everything
l AS (SELECT a.fill, (SELECT sum(least(b.cap, a.fill * b.weight)) FROM f b) AS spends, (SELECT sum(source_size) FROM f) AS total FROM f a),
lo AS (SELECT coalesce(max(fill), 0) AS fill FROM l WHERE spends <= total),
lv AS (SELECT ((SELECT sum(source_size) FROM f) - coalesce(sum(cap) FILTER (f.fill <= lo.fill), 0)) / nullif(sum(weight) FILTER (f.fill > lo.fill), 0) AS level FROM f, lo),
g AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap))::DOUBLE AS target FROM f, lv),
p AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM e
"""

OP8 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
d AS (SELECT DISTINCT doc_id, g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM d a JOIN d b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 75 * (a.n + b.n - k)),
r(u, v) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
m AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.doc_id = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op3_decontamination": OP3, "op5_mixing": OP5, "op8_minhash": OP8}
