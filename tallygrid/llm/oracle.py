"""SQL for DuckDB that gives the same rows as the queries it can express."""

from __future__ import annotations

# words and distinct shingles of any table with an id and a text
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER}, '[^ \\t\\n\\x0B\\f\\r]+')"


def shingles(table: str, id_col: str) -> str:
    return f'''
    SELECT id, row, unnest(CASE
        WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3),
                              lambda i: array_to_string(w[i:i + 4], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
        ELSE [] END) AS s
    FROM (SELECT {id_col} AS id, row_number() OVER () AS row, {WORDS} AS w FROM {table})'''


ORACLES: dict[str, str] = {
    "op1_decontamination": f'''
WITH item AS ({shingles('benchmark', 'item_id')}),
     doc AS ({shingles('documents', 'doc_id')}),
     size AS (SELECT row, count(*) AS n FROM item GROUP BY row)
SELECT doc.id AS doc_id, item.id AS item_id, any_value(size.n)::INTEGER AS n_item,
       count(*)::INTEGER AS n_shared
FROM doc JOIN item USING (s) JOIN size ON size.row = item.row
GROUP BY doc.id, doc.row, item.id, item.row
HAVING 100 * count(*) >= 75 * any_value(size.n)
''',
    "op7_substrings": f'''
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
     win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM doc WHERE len(w) >= 20),
     named AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS win FROM win),
     later AS (SELECT doc_id, s FROM (SELECT doc_id, s,
                   row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS place FROM named)
               WHERE place > 1),
     gone AS (SELECT doc_id, list(DISTINCT p) AS ps
              FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
           list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM doc LEFT JOIN gone USING (doc_id)
''',
    "op8_jaccard": f'''
WITH RECURSIVE sh AS MATERIALIZED ({shingles('documents', 'doc_id')}),
     n AS MATERIALIZED (SELECT id, count(*) AS n FROM sh GROUP BY id),
     link AS MATERIALIZED (
         SELECT a.id AS a, b.id AS b
         FROM sh a JOIN sh b ON a.s = b.s AND a.id <> b.id
         JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id
         GROUP BY a.id, b.id
         HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
     reach AS (SELECT doc_id AS id, doc_id AS other FROM documents
               UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT reach.id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles,
       min(reach.other)::BIGINT AS component_id
FROM reach LEFT JOIN n ON n.id = reach.id GROUP BY reach.id
''',
    "op11_sharding": '''
WITH RECURSIVE crc_table AS MATERIALIZED (
         SELECT list(v ORDER BY b) AS t FROM (
             SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k:
                        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
             FROM range(256) r(b))),
     sized AS (
         SELECT doc_id, (strlen(s) + 1)::BIGINT AS size,
                xor(4294967295, list_reduce(
                    list_prepend(4294967295::BIGINT, list_transform(range(strlen(s)),
                        lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))::BIGINT AS text_crc32
         FROM (SELECT doc_id, coalesce(text, '') AS s, hex(encode(coalesce(text, ''))) AS h FROM documents), crc_table),
     hop AS (
         SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 16))::UBIGINT::HUGEINT AS k,
                -1::BIGINT AS place, 0::BIGINT AS nxt
         FROM documents
         UNION ALL
         SELECT doc_id, k, nxt, floor((nxt + 1)::DOUBLE * (2147483648::DOUBLE / ((k >> 33) + 1)::DOUBLE))::BIGINT
         FROM (SELECT doc_id, nxt, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k
               FROM hop WHERE nxt < 16)),
     sharded AS (
         SELECT doc_id, size, text_crc32, place AS shard, CASE WHEN nxt = 16 THEN 16 ELSE place END AS grown
         FROM hop JOIN sized USING (doc_id) WHERE nxt >= 16)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot,
       grown::INTEGER AS grown_shard
FROM sharded
''',
    "op12_middle": '''
WITH doc AS (
         SELECT doc_id, coalesce(text, '') AS s, sha256('1:' || doc_id) AS d,
                regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
         FROM documents),
     drawn AS (
         SELECT *, len(u)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
                ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
         FROM doc),
     parts AS (
         SELECT doc_id, s, n,
                CASE WHEN s = '' OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>')
                          OR h3 % 100 >= 90 THEN 'plain'
                     WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
                array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
                array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') AS z
         FROM drawn)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN s
                        WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m
                        ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN s ELSE p || m || z END) AS restored_sha256
FROM parts
''',
    "op13_filter_audit": '''
WITH RECURSIVE doc AS (
         SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS s,
                regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w
         FROM documents),
     failed AS (
         SELECT doc_id, part,
                CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
                || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(s, '[^A-Z]', '', 'g')) > 2 * length(s) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(s, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY s) THEN 'E' ELSE '' END AS fails
         FROM doc),
     label AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic
               FROM labels GROUP BY doc_id),
     tally AS MATERIALIZED (
         SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
         FROM failed LEFT JOIN label USING (doc_id) GROUP BY part, fails),
     orders AS (SELECT '' AS filter_order UNION ALL
                SELECT filter_order || l FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) f(l)
                WHERE NOT contains(filter_order, l)),
     stepped AS (
         SELECT filter_order, step, filter_order[step:step] AS f, filter_order[1:step - 1] AS earlier
         FROM orders, range(1, 6) r(step) WHERE length(filter_order) = 5),
     gone AS (
         SELECT part, filter_order, step, f, fails, n, good, toxic, contains(fails, f) AS fails_own,
                len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND fails <> '' AND earlier <> '' AS fails_earlier
         FROM stepped, tally),
     report AS (
         SELECT part, filter_order, step, f,
                sum(CASE WHEN NOT fails_own AND NOT fails_earlier THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN fails_own AND NOT fails_earlier THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN fails_own AND fails_earlier THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN fails_own AND NOT fails_earlier THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN fails_own AND NOT fails_earlier THEN toxic ELSE 0 END) AS toxic_lost
         FROM gone GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM report
''',
}
