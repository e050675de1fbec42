"""The queries again, as DuckDB SQL over the same tables."""

from corpusward.llm.notices import TEMPLATES

OP5 = r"""
WITH rows AS (
    SELECT doc_id, source, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))) AS key,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
    FROM documents
), sources AS (
    SELECT source, sum(size) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM rows GROUP BY source
), in_order AS (
    SELECT *, 3 * source_size AS most, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS words_left,
           sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
    FROM sources
    WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shared AS (
    SELECT *, most * weight_left <= weight * words_left AS is_full,
           max(CASE WHEN most * weight_left > weight * words_left THEN CAST(words_left AS DOUBLE) / CAST(weight_left AS DOUBLE) END) OVER () AS share
    FROM in_order
), targets AS (
    SELECT source, source_size, CASE WHEN is_full THEN CAST(most AS DOUBLE) ELSE weight * share END AS target FROM shared
), budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets
), running AS (
    SELECT r.*, b.source_size, b.target, b.epochs, floor(b.target) - b.epochs * b.source_size AS rest,
           sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key) AS reached,
           sum(r.size) OVER (PARTITION BY r.source, r.key) AS words, count(*) OVER (PARTITION BY r.source, r.key) AS copies
    FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(epochs * size + CASE WHEN reached <= rest THEN size
                                 WHEN reached - words < rest THEN floor((rest - (reached - words)) / copies) ELSE 0 END AS BIGINT) AS taken
FROM running
"""

OP7 = """
WITH hashed AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), first AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM first
"""

OP10 = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, d.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
    FROM whole q JOIN whole d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP2 = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), neighbours AS (
    SELECT t.*, coalesce(lead(doc_id) OVER down, first_value(doc_id) OVER down) AS next_id FROM texts t WINDOW down AS (ORDER BY doc_id DESC)
), changed AS (
    SELECT n.doc_id, n.next_id, n.text, left(n.text, length(n.text) - length(n.text) // 2) || left(f.text, length(n.text) // 2) AS changed
    FROM neighbours n JOIN texts f ON f.doc_id = n.next_id
), versions AS (
    SELECT doc_id, 'own' AS kind, text FROM texts UNION ALL SELECT doc_id, 'edited', changed FROM changed
), words AS (
    SELECT DISTINCT doc_id, kind, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM versions
), frequencies AS (
    SELECT term, count(*) AS df FROM words WHERE kind = 'own' AND term <> '' GROUP BY term
), band AS (
    SELECT term FROM frequencies WHERE ln((SELECT count(*) FROM texts) / df) BETWEEN 0.7 AND 5.0
), marked AS (
    SELECT w.*, b.term IS NOT NULL AS held, max(b.term IS NOT NULL) OVER (PARTITION BY w.doc_id, w.kind) AS any_held
    FROM words w LEFT JOIN band b USING (term) WHERE w.term <> ''
), bounds AS (
    SELECT k, CASE WHEN k < 1 THEN 'g' WHEN k < 2 THEN '400' WHEN k < 4 THEN '100' WHEN k < 12 THEN '080' WHEN k < 28 THEN '040' WHEN k < 44 THEN '020' ELSE '008' END AS bound
    FROM range(60) t(k)
), parts AS (
    SELECT doc_id, kind, k, left(md5(string_agg(term, ' ' ORDER BY term)), 8) AS part
    FROM marked, bounds
    WHERE (held OR NOT any_held) AND left(md5(concat(k, ':', term)), 3) < bound
    GROUP BY ALL
), prints AS (
    SELECT v.doc_id, v.kind, list(coalesce(p.part, '') ORDER BY b.k) AS parts
    FROM versions v CROSS JOIN bounds b LEFT JOIN parts p ON p.doc_id = v.doc_id AND p.kind = v.kind AND p.k = b.k
    GROUP BY ALL
), compared AS (
    SELECT c.doc_id, length(c.text) AS n_chars, sha256(c.changed) AS edited_sha256, o.parts AS own, e.parts AS edited,
           list_zip(o.parts, e.parts) AS with_edited, list_zip(o.parts, n.parts) AS with_next
    FROM changed c JOIN prints o ON o.doc_id = c.doc_id AND o.kind = 'own' JOIN prints e ON e.doc_id = c.doc_id AND e.kind = 'edited'
         JOIN prints n ON n.doc_id = c.next_id AND n.kind = 'own'
)
SELECT doc_id, n_chars, edited_sha256, array_to_string(own, '-') AS fingerprint, array_to_string(edited, '-') AS edited_fingerprint,
       coalesce(len(list_filter(with_edited, lambda p: p[1] <> '' AND p[1] = p[2])) / nullif(len(list_filter(with_edited, lambda p: p[1] <> '' OR p[2] <> '')), 0), 1.0) AS near_edited,
       coalesce(len(list_filter(with_next, lambda p: p[1] <> '' AND p[1] = p[2])) / nullif(len(list_filter(with_next, lambda p: p[1] <> '' OR p[2] <> '')), 0), 1.0) AS near_next
FROM compared
"""

OP9 = r"""
WITH files AS (
    SELECT doc_id, source AS repo, coalesce(lang, '') || '/' || doc_id // 1000 || '/' ||
           CASE WHEN doc_id % 8 = 3 THEN 'LICENSE-' || doc_id ELSE (doc_id // 100) % 10 || '/' || doc_id || '.txt' END AS path,
           doc_id % 8 = 3 AS is_licence, lower(coalesce(text, '')) AS text
    FROM documents
), notices(n, licence, text) AS (
    VALUES NOTICES
), template_counts AS (
    SELECT n, licence, term, count(*) AS c
    FROM (SELECT n, licence, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM notices) WHERE term <> '' GROUP BY ALL
), df AS (
    SELECT term, count(DISTINCT doc_id) AS df
    FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+')) AS term FROM files) GROUP BY term
), idf AS (
    SELECT t.term, ln((1 + (SELECT count(*) FROM files)) / (1 + coalesce(df, 0))) + 1 AS idf
    FROM (SELECT term FROM template_counts UNION SELECT term FROM df) t LEFT JOIN df USING (term)
), templates AS (
    SELECT n, licence, term, c * idf / sqrt(sum(c * c * idf * idf) OVER (PARTITION BY n)) AS share FROM template_counts JOIN idf USING (term)
), passages AS (
    SELECT DISTINCT doc_id, unnest(list_concat(regexp_split_to_array(text, '\r\n|\r|\n'), regexp_split_to_array(text, '\n[ \t\r]*\n'),
                                               CASE WHEN is_licence THEN [text] ELSE [] END)) AS passage
    FROM files
), counts AS (
    SELECT doc_id, passage, term, count(*) AS c
    FROM (SELECT doc_id, passage, unnest(regexp_split_to_array(passage, '[^\p{L}\p{N}]+')) AS term FROM passages) WHERE term <> '' GROUP BY ALL
), weighed AS (
    SELECT c.*, c.c * idf AS weight FROM counts c JOIN idf USING (term)
), lengths AS (
    SELECT doc_id, passage, sqrt(sum(weight * weight)) AS length FROM weighed GROUP BY ALL
), scored AS (
    SELECT w.doc_id, t.licence, round(sum(w.weight * t.share) / any_value(l.length), 6) AS score
    FROM weighed w JOIN templates t USING (term) JOIN lengths l ON l.doc_id = w.doc_id AND l.passage = w.passage
    GROUP BY w.doc_id, w.passage, t.n, t.licence
), own AS (
    SELECT doc_id, licence, score FROM scored WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1
), placed AS (
    SELECT f.doc_id, f.repo, f.path, f.is_licence, regexp_replace(f.path, '/[^/]*$', '') AS directory, o.licence, o.score
    FROM files f LEFT JOIN own o USING (doc_id)
), licensed AS (
    SELECT repo, directory, licence FROM placed WHERE is_licence AND licence IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY repo, directory ORDER BY score DESC, licence, path) = 1
), above AS (
    SELECT p.doc_id, l.licence, l.directory
    FROM placed p JOIN licensed l ON l.repo IS NOT DISTINCT FROM p.repo AND (p.directory = l.directory OR starts_with(p.directory, l.directory || '/'))
    WHERE p.licence IS NULL QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY length(l.directory) DESC) = 1
)
SELECT p.doc_id, p.path, p.licence AS own_licence, p.score AS own_score, coalesce(p.licence, a.licence) AS licence, a.directory AS given_by
FROM placed p LEFT JOIN above a USING (doc_id)
"""

# CRC-32 of a string column, from its UTF-8 bytes; ``crc`` is a list of the 256 values for single bytes.
CRC_TABLE = """SELECT list(v ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) AS t(n))"""


def crc32(text: str) -> str:
    in_bytes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {in_bytes}), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])))"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11 = rf"""
WITH RECURSIVE crcs AS ({CRC_TABLE}), runs AS (
    SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS times
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (
    SELECT run, times, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crcs WHERE length(run) >= 6
), counted AS (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
), words AS (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM counted WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), shorter AS (
    SELECT word, place, left(word, place) || substring(word, place + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS place FROM words)
), links AS (
    SELECT DISTINCT a.word, b.word AS near FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
    UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
    UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word
), best AS (
    SELECT l.word, count(*) AS n_near, max(w.n) AS near_n, min_by(w.word, (-w.n, w.word)) AS near FROM links l JOIN words w ON w.word = l.near GROUP BY l.word
), forms AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
    FROM words LEFT JOIN best USING (word)
), steps AS (
    SELECT word, word AS at FROM forms
    UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NOT NULL
), ends AS (
    SELECT s.word, s.at AS root FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NULL
)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN ends USING (word)
"""

OP12 = rf"""
WITH terms AS (
    SELECT row, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
), asked AS (
    SELECT DISTINCT item_id, term FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), sizes AS (
    SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY row
), whole AS (
    SELECT count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS length FROM sizes
), counts AS (
    SELECT row, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counts, whole GROUP BY term, documents
), scored AS (
    SELECT a.item_id, c.row, s.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // length)))) AS BIGINT) AS score
    FROM asked a JOIN counts c USING (term) JOIN weights USING (term) JOIN sizes s USING (row), whole GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

OP13 = f"""
WITH RECURSIVE crcs AS ({CRC_TABLE}), rows AS (
    SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest, strlen(coalesce(text, '')) + 8 AS size FROM documents
), whole AS (
    SELECT digest, CAST(sum(size) AS BIGINT) AS size FROM rows GROUP BY digest
), by_size AS (
    SELECT *, row_number() OVER w AS place, sum(size) OVER () - sum(size) OVER w + size AS left_over FROM whole WINDOW w AS (ORDER BY size DESC, digest)
), alone AS (
    SELECT digest, place FROM by_size WHERE place < coalesce((SELECT min(place) FROM by_size WHERE size * (25 - place) <= left_over), 25)
), rest AS (
    SELECT digest, size, CAST(sum(size) OVER (ORDER BY digest) AS BIGINT) AS upto FROM whole WHERE digest NOT IN (SELECT digest FROM alone)
), facts AS (
    SELECT list_prepend(0::BIGINT, list(upto ORDER BY upto)) AS ends, max(upto) AS total, max(size) AS largest, 24 - (SELECT count(*) FROM alone) AS shards FROM rest HAVING count(*) > 0
), search AS (  -- the capacity lies from low to high
    SELECT greatest(-(-total // shards), largest) AS low, total AS high FROM facts
    UNION ALL
    SELECT CASE WHEN fits THEN low ELSE middle + 1 END, CASE WHEN fits THEN middle ELSE high END FROM (
        SELECT low, high, middle, list_reduce(list_prepend(0::BIGINT, range(shards)), lambda reach, k: list_max(list_filter(ends, lambda e: e <= reach + middle))) >= total AS fits
        FROM (SELECT low, high, (low + high) // 2 AS middle FROM search WHERE low < high), facts)
), bound AS (
    SELECT low AS capacity FROM search WHERE low = high
), earliest AS (
    SELECT shards AS k, total AS least FROM facts
    UNION ALL SELECT k - 1, list_min(list_filter(ends, lambda e: e >= least - capacity)) FROM earliest, facts, bound WHERE k > 1
), cuts AS (
    SELECT 0::BIGINT AS k, 0::BIGINT AS reach
    UNION ALL
    SELECT k, least(greatest(CASE WHEN even - before <= after - even THEN before ELSE after END, least), list_max(list_filter(ends, lambda e: e <= reach + capacity))) FROM (
        SELECT e.k, reach, least, even, ends, capacity, list_min(list_filter(ends, lambda e: e >= even)) AS after,
               coalesce(list_max(list_filter(ends, lambda e: e < even)), -total) AS before
        FROM (SELECT c.k + 1 AS k, reach, reach + (total - reach)::DOUBLE / (shards - c.k)::DOUBLE AS even FROM cuts c, facts WHERE c.k + 1 < shards) n
        JOIN earliest e ON e.k = n.k, facts, bound)
), placed AS (
    SELECT digest, place - 1 AS shard FROM alone
    UNION ALL SELECT digest, (SELECT count(*) FROM alone) + (SELECT count(*) FROM cuts WHERE k > 0 AND reach < upto) FROM rest
)
SELECT doc_id, size, {crc32("text")} AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM rows JOIN placed USING (digest), crcs
"""

OP9 = OP9.replace("NOTICES", ", ".join(f"({n}, '{name}', '{text}')" for n, (name, text) in enumerate((name, text.replace("'", "''")) for name, text in TEMPLATES)))

ORACLES = {
    "op2_imatch_fingerprints": OP2,
    "op5_source_mixing": OP5,
    "op7_warc_archive": OP7,
    "op9_licence_scan": OP9,
    "op10_exact_top_k": OP10,
    "op11_spelling_variants": OP11,
    "op12_lexical_search": OP12,
    "op13_sharding": OP13,
}
