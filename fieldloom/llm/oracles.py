"""SQL for the queries op11 and op12, whose contracts draw on CRC-32."""

from __future__ import annotations


def _crc(numbers: str) -> str:
    """The CRC-32 of a list of bytes; needs the row of _CRC."""
    return f"xor(list_reduce([4294967295::BIGINT] || {numbers}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


#: What every byte does; 3988292384 is the polynomial, bits reversed.
_CRC = "crc AS MATERIALIZED (SELECT list(v ORDER BY k) AS tab FROM (SELECT k, list_reduce([k::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(k)))"
#: The bytes of a word in UTF-8: its letters are below 256, so one or two each.
_BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, 128 + (unicode(x) & 63)] END))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Neighbours: words that are equal without their k-th letters, or of which one is the other without one letter.
VARIANTS = rf"""WITH RECURSIVE {_CRC},
    o AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
    d AS (SELECT run, n, {_crc(_BYTES.format("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM (SELECT doc_id, run, count(*) AS n FROM o GROUP BY ALL), crc),
    w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM d) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    cut AS MATERIALIZED (SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w)),
    near AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
    best AS MATERIALIZED (SELECT word, count(*) AS n_near, max(m) AS m, min(other) FILTER (m = most) AS other FROM (SELECT *, max(m) OVER (PARTITION BY word) AS most FROM near) GROUP BY word),
    f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
    up(word, top) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.top WHERE f.form IS NOT NULL)
    SELECT f.word, form, top AS root, n, n_near, form_n FROM f JOIN (SELECT up.word, top FROM up JOIN f ON f.word = top WHERE f.form IS NULL) t ON t.word = f.word"""

#: A stretch of period q: words equal to those q before. Of stretches with the same ends the one of smallest period counts: the other periods are its multiples.
RUNS = rf"""WITH {_CRC},
    t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")} AS h FROM documents, crc),
    p AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
    s AS MATERIALIZED (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM p),
    x AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM s),
    e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i < b.i),
    stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM e) GROUP BY doc_id, q, part HAVING count(*) >= 3 * q AND count(*) + q >= 6),
    r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY ALL),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
    told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
    top AS (SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.doc_id = b.doc_id AND (b.length * a.period > a.length * b.period OR (b.length * a.period = a.length * b.period AND (b.start < a.start OR (b.start = a.start AND b.period < a.period))))))
    SELECT documents.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM documents LEFT JOIN told ON told.doc_id = documents.doc_id LEFT JOIN top ON top.doc_id = documents.doc_id LEFT JOIN kept ON kept.doc_id = documents.doc_id"""
