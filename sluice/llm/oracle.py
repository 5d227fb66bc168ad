r"""DuckDB SQL for the queries that SQL can express on whole tables.

Operators 1, 4, 6, 11 and 13 have results that do not depend on the method. The others learn a model, choose their own order or
use a hash that DuckDB does not have; ``tests/llm`` compares those with plain versions.
"""

from __future__ import annotations

#: A word, and its lower-case text with A-Z folded only.
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_FOLDED = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The step of CRC-32 per byte value, as a list in the one row of ``crc_table``.
_CRC_TABLE = """crc_table AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS step
)"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8; ``step`` is the table's list."""
    data = f"hex(encode({text}))"
    values = f"list_transform(range(0, length({data}), 2), lambda i: ('0x' || substr({data}, i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({values}, lambda c, b: xor(step[xor(c, b) % 256 + 1], c // 256), 4294967295::BIGINT), 4294967295)"


OP1 = """
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS data FROM documents
), strings AS (
    SELECT doc_id, i AS start, substr(data, 2 * i + 1, 100) AS string
    FROM (SELECT doc_id, data, unnest(range(0, greatest(length(data) // 2 - 49, 0))) AS i FROM texts)
), firsts AS (
    SELECT doc_id, start, min(doc_id) OVER (PARTITION BY string) AS first_doc FROM strings
), gone AS (
    SELECT doc_id, start, lag(start) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM firsts WHERE first_doc < doc_id
), numbered AS (
    SELECT doc_id, start, sum(CASE WHEN before IS NULL OR start > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM gone
), spans AS (
    SELECT doc_id, span, min(start) AS s, max(start) + 50 AS e FROM numbered GROUP BY doc_id, span
), held AS (
    SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS kept_from FROM spans
), kept AS (
    SELECT h.doc_id, string_agg(substr(data, 2 * kept_from + 1, 2 * (s - kept_from)), '' ORDER BY s) AS head, max(e) AS last, sum(e - s) AS n_removed, count(*) AS n_spans
    FROM held h JOIN texts t USING (doc_id) GROUP BY h.doc_id
)
SELECT t.doc_id, (length(data) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(head || substr(data, 2 * last + 1), data))) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""

OP4 = f"""
WITH RECURSIVE texts AS (
    SELECT doc_id, {_WORDS.format(text=_FOLDED.format(text="coalesce(text, '')"))} AS words FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM texts WHERE len(words) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common o JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

OP6 = f"""
WITH texts AS (
    SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents
), windows AS (
    SELECT doc_id, i AS start, array_to_string(words[i:i + 19], ' ') AS run
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS i FROM texts)
), ranked AS (
    SELECT doc_id, start, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS place FROM windows
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS word FROM ranked WHERE place > 1
), removed AS (
    SELECT doc_id, list(word) AS numbers FROM gone GROUP BY doc_id
), places AS (
    SELECT doc_id, words[i] AS word, i FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM texts)
), kept AS (
    SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS kept FROM places p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.word = p.i GROUP BY p.doc_id
)
SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(len(numbers), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

OP11 = f"""
WITH {_CRC_TABLE}, texts AS (
    SELECT doc_id, regexp_extract_all({_FOLDED.format(text="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), target AS (
    SELECT item_id, regexp_extract_all({_FOLDED.format(text="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
), features AS (
    SELECT doc_id, array_to_string(words[i:i + n - 1], ' ') AS feature, count(*) AS times
    FROM (SELECT doc_id, words, n, unnest(range(1, greatest(len(words) - n + 2, 1))) AS i FROM texts, (SELECT unnest([1, 2, 3]) AS n)) GROUP BY 1, 2
), target_features AS (
    SELECT array_to_string(words[i:i + n - 1], ' ') AS feature, count(*) AS times
    FROM (SELECT words, n, unnest(range(1, greatest(len(words) - n + 2, 1))) AS i FROM target, (SELECT unnest([1, 2, 3]) AS n)) GROUP BY 1
), hashed AS (
    SELECT feature, {_crc32("feature")} % 10000 AS bucket FROM (SELECT feature FROM features UNION SELECT feature FROM target_features), crc_table
), own AS (
    SELECT bucket, sum(times)::DOUBLE AS s FROM features JOIN hashed USING (feature) GROUP BY bucket
), wanted AS (
    SELECT bucket, sum(times)::DOUBLE AS t FROM target_features JOIN hashed USING (feature) GROUP BY bucket
), totals AS (
    SELECT (SELECT coalesce(sum(s), 0) FROM own) AS S_all, (SELECT coalesce(sum(t), 0) FROM wanted) AS T_all
), gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (S_all + 10000) / ((s + 1) * (T_all + 10000))))::BIGINT AS gain FROM own LEFT JOIN wanted USING (bucket), totals
), weighed AS (
    SELECT doc_id, sum(times)::BIGINT AS n_features, sum(times * gain)::BIGINT AS weight FROM features JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
    SELECT doc_id, len(words) >= 20 AS able, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM texts LEFT JOIN weighed USING (doc_id)
), ranked AS (
    SELECT *, CASE WHEN able THEN row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (able) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM ranked
"""

OP13 = f"""
WITH RECURSIVE {_CRC_TABLE}, damaged AS (
    SELECT conv_id AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("name")} % 20 AS kind
        FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations), crc_table
    ) WHERE kind <> 0
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare FROM damaged
), marked AS (
    SELECT conv, turn, role, text, k, substr(role, 1, 1) AS initial, lead(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY k) AS next_initial,
        CASE WHEN bare = '' THEN 0 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY k) > 1 THEN 1 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 2 ELSE 3 END AS mark
    FROM ordered
), counts AS (
    SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (mark = 0) AS blank, count(*) FILTER (mark = 1) AS duplicate,
        count(*) FILTER (mark = 2) AS truncated, count(*) FILTER (next_initial IS NOT NULL AND initial || next_initial NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS rows
    FROM marked GROUP BY conv
), inserts AS (
    -- states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
    SELECT * FROM (VALUES (0, 0, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
        (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])) AS v(here, there, letters, lines)
), best(conv, k, state, cost, audit, lines) AS (
    SELECT conv, 0::BIGINT, there, 3 * length(letters), letters, lines::VARCHAR[] FROM counts, inserts WHERE here = 0
    UNION ALL
    SELECT conv, k, state, cost, audit, lines FROM (
        SELECT conv, k, there AS state, cost + 3 * length(letters) AS cost, audit || letters AS audit, list_concat(e.lines, i.lines::VARCHAR[]) AS lines
        FROM (
            SELECT b.conv, m.k, b.cost + CASE letter WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN letter <> 'D' AND mark = 2 THEN 3 ELSE 0 END AS cost, audit || letter AS audit,
                CASE letter
                    WHEN 'D' THEN b.state
                    WHEN 'R' THEN CASE b.state WHEN 2 THEN 3 ELSE 2 END
                    ELSE CASE WHEN initial = 's' AND b.state = 0 THEN 1 WHEN initial = 'u' AND b.state <> 2 THEN 2 WHEN initial = 'a' AND b.state = 2 THEN 3 END
                END AS state,
                CASE letter WHEN 'D' THEN b.lines WHEN 'K' THEN list_append(b.lines, role || ':' || text) ELSE list_append(b.lines, CASE b.state WHEN 2 THEN 'assistant:' ELSE 'user:' END || text) END AS lines
            FROM best b JOIN marked m ON m.conv IS NOT DISTINCT FROM b.conv AND m.k = b.k + 1, (SELECT unnest(['D', 'K', 'R']) AS letter)
            WHERE letter = 'D' OR mark >= 2
        ) e JOIN inserts i ON i.here = e.state
    ) QUALIFY row_number() OVER (PARTITION BY conv, state ORDER BY cost, audit) = 1
), final AS (
    SELECT b.conv, cost, audit, lines FROM best b JOIN counts c ON c.conv IS NOT DISTINCT FROM b.conv AND b.k = c.rows
    WHERE state IN (0, 3) QUALIFY row_number() OVER (PARTITION BY b.conv ORDER BY cost, audit) = 1
)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON c.conv IS NOT DISTINCT FROM d.conv_id LEFT JOIN final f ON f.conv IS NOT DISTINCT FROM d.conv_id
"""

ORACLES: dict[str, str] = {"op1_suffixes": OP1, "op4_jaccard": OP4, "op6_substrings": OP6, "op11_resampling": OP11, "op13_conversations": OP13}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
