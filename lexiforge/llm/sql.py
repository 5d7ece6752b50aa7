"""DuckDB twins of the queries that SQL can express."""

WORDS = r"[^\x20\x09-\x0D]+"

#: Sources share the words of the corpus; the level is where the capped targets add up to it.
OP1 = rf"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size, text,
           length(text) - length(translate(text, '0123456789#*$%&|<>!ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS odd
    FROM documents),
k AS (
    SELECT doc_id, source, size,
           -ln((('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size::VARCHAR), 1, 13))::BIGINT + 0.5)
               / 4503599627370496.0)
           / greatest(0.05, coalesce(1 - odd::DOUBLE / greatest(length(text), 1), 0.05)) AS key
    FROM d),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w
    FROM k GROUP BY source),
b AS (
    SELECT *, sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER before, 0) AS remaining,
           sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS free
    FROM s WINDOW before AS (ORDER BY 3.0 * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (
    SELECT min_by(greatest(remaining, 0) / free, 3.0 * source_size / w) AS level
    FROM b WHERE greatest(remaining, 0) / free * w <= 3.0 * source_size),
t AS (
    SELECT source, source_size, least(3.0 * source_size, coalesce((SELECT level FROM lv) * w, 3.0 * source_size))::DOUBLE AS target FROM b),
e AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
p AS (
    SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
           sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id ASC NULLS LAST, size ROWS UNBOUNDED PRECEDING) - k.size / 2 AS half
    FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN epochs < 3 AND half <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""


OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
win AS (
    SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS s FROM d, unnest(range(1, len(w) - 48)) AS t(k) WHERE len(w) >= 50),
low AS (SELECT s, min(doc_id) AS first_id FROM win GROUP BY s),
gone AS (
    SELECT DISTINCT win.doc_id, p FROM win JOIN low USING (s), unnest(range(k, k + 50)) AS u(p) WHERE first_id < win.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Links are all pairs of documents whose shingle sets reach the similarity; classes are what links reach.
OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS shingle
    FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
    SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * shared >= 4 * (x.n + y.n)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON r = a)
SELECT doc_id, min(r) AS class_id, (SELECT count(*) FROM both_ways WHERE a = reach.doc_id)::BIGINT AS n_links FROM reach GROUP BY doc_id
"""

OP6 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""



def _crc_table() -> str:
    """The steps of CRC-32 for each byte, from its polynomial."""
    rows = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        rows.append(str(c))
    return f"[{', '.join(rows)}]::BIGINT[]"


#: Near words meet in what is left when a code point is masked or taken out.
OP11 = rf"""
WITH RECURSIVE crc AS (SELECT {_crc_table()} AS t),
occ AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n FROM occ GROUP BY ALL),
x AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || run)) AS hx FROM r),
h AS (
    SELECT run, n, xor(list_reduce(list_transform(range(0, length(hx) // 2), lambda k: ('0x' || substr(hx, 2 * k + 1, 2))::BIGINT),
                       lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
    FROM x, crc),
m AS (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
c AS (
    SELECT word, n, unnest(list_transform(range(1, length(word) + 1), lambda k: substr(word, 1, k - 1) || '*' || substr(word, k + 1))) AS masked,
           unnest(list_transform(range(1, length(word) + 1), lambda k: substr(word, 1, k - 1) || substr(word, k + 1))) AS rest FROM w),
p AS (
    SELECT a.word AS word, b.word AS near, b.n AS near_n FROM c a JOIN c b ON a.masked = b.masked AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM c JOIN w ON c.rest = w.word
    UNION SELECT w.word, c.word, c.n FROM c JOIN w ON c.rest = w.word),
b AS (
    SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (
    SELECT w.word, CASE WHEN near_n >= 2 * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near,
           CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
    FROM w LEFT JOIN b USING (word)),
way(word, w, k) AS (
    SELECT word, word, 0 FROM f UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN f ON f.word = way.w WHERE f.form IS NOT NULL),
e AS (SELECT word, max_by(w, k) AS root FROM way GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM f JOIN e USING (word)
"""

OP12 = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
           sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS hx FROM documents),
h AS (
    SELECT doc_id, text, u, len(u) AS n, [('0x' || substr(hx, 8 * k + 1, 8))::BIGINT for k in range(0, 4)] AS h FROM d),
c AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (
    SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
           coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM s
"""

ORACLES = {"op1_mixing": OP1, "op3_substring_dedup": OP3, "op5_jaccard_join": OP5, "op6_topk": OP6, "op11_spelling": OP11, "op12_fim": OP12}
