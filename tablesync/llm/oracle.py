"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from tablesync.llm.common import SPACE, UPPER
from tablesync.llm.licenses import BETWEEN, COVER, MIN_VOTES, TEMPLATES
from tablesync.llm.mixing import PERIOD
from tablesync.llm.secrets import (
    ACCESS,
    ASSIGN,
    ASSIGN_CHARS,
    HEX,
    KEY,
    OWNERS_LEAST,
    OWNERS_SHARE,
    REPOSITORIES_LEAST,
    REPOSITORIES_SHARE,
)

_SPACE = " || ".join(f"chr({ord(c)})" for c in SPACE)
# RE2 knows no quantifier above 1000; those of the patterns are below. Quotes are doubled for SQL.
_QUOTED = {k: p.replace("'", "''") for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("owned", KEY))}
_SPANS = " UNION ALL ".join(f"""
    SELECT doc_id, source, {i} AS kind, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits,
        regexp_extract_all(t, '{p}', {2 if k == "assign" else 0}) AS secrets FROM texts WHERE regexp_matches(t, '{p}')
    """ for i, (k, p) in enumerate(_QUOTED.items()))

_TEMPLATES = ", ".join(f"({i}, '{t.label}', {t.words!r}, {t.base}, {t.tolerance})" for i, t in enumerate(TEMPLATES))

ORACLE: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        keyed AS (SELECT *, translate(trim(line, {_SPACE}), '{UPPER}', '{UPPER.lower()}') AS key FROM lines),
        common AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (
            SELECT doc_id, i, line, c.key IS NOT NULL AND doc_id <> c.last AS gone FROM keyed LEFT JOIN common c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    # One period of the schedule by recursion over its slots; the state is the number of blocks given to each source.
    "op2_mixing": f"""
        WITH RECURSIVE counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        weighed AS (SELECT source, CAST(floor(sqrt(n)) AS BIGINT) AS w FROM counted),
        shares AS (
            SELECT source, greatest(1, (2 * w * {PERIOD} + total) // (2 * total)) AS share,
                row_number() OVER (ORDER BY source NULLS FIRST) AS k
            FROM weighed, (SELECT sum(w)::BIGINT AS total FROM weighed)),
        parts AS (SELECT list(share::BIGINT ORDER BY k) AS p, sum(share)::BIGINT AS period, count(*)::BIGINT AS n FROM shares),
        slots AS (
            SELECT -1::BIGINT AS t, list_transform(p, lambda x: 0::BIGINT) AS given, 0::BIGINT AS k, p, period, n FROM parts
            UNION ALL
            SELECT t, list_transform(range(1, n + 1), lambda i: given[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick, p, period, n
            FROM (
                SELECT t + 1 AS t, given, p, period, n, list_min(list_transform(
                    list_filter(range(1, n + 1), lambda i: given[i] * period // p[i] <= t + 1),
                    lambda i: ((given[i] + 1) * period + p[i] - 1) // p[i] * 1000000 + i)) % 1000000 AS pick
                FROM slots WHERE t + 1 < period)),
        places AS (SELECT k, period, list(t ORDER BY t) AS slots FROM slots WHERE t >= 0 GROUP BY k, period),
        numbered AS (
            SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS i
            FROM documents)
        SELECT doc_id, d.source, i // 16 AS block, (i // 16) // share * period + slots[(i // 16) % share + 1] AS slot, i % 16 AS pos
        FROM numbered d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source JOIN places USING (k)""",
    "op6_secrets": f"""
        WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        found AS ({_SPANS}),
        matches AS (
            SELECT doc_id, source, kind, unnest(hits) AS hit, unnest(secrets) AS secret, unnest(gaps[:len(hits)]) AS gap,
                unnest(range(len(hits))) AS i FROM found),
        placed AS (
            SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM matches),
        spans AS (
            SELECT doc_id, source, kind, secret, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop FROM placed
            WHERE CASE kind WHEN 0 THEN length(secret) >= {ASSIGN_CHARS} WHEN 3 THEN regexp_matches(secret, '[0-9]')
                AND regexp_matches(secret, '[a-z]') AND regexp_matches(secret, '[A-Z]') ELSE true END),
        totals AS (
            SELECT greatest({OWNERS_LEAST}, (count(DISTINCT coalesce('1' || source, '0')) * {OWNERS_SHARE} + 99) // 100) AS of_owners,
                greatest({REPOSITORIES_LEAST}, (count(DISTINCT t) * {REPOSITORIES_SHARE} + 9999) // 10000) AS of_repositories
            FROM texts),
        owners AS (
            SELECT secret, count(DISTINCT coalesce('1' || s.source, '0')) AS n_owners, count(DISTINCT t) AS n_repositories
            FROM spans s JOIN texts USING (doc_id) GROUP BY secret),
        marked AS (
            SELECT s.*, n_owners, n_repositories,
                NOT (n_owners >= of_owners AND n_repositories >= of_owners OR n_repositories >= of_repositories) AS live
            FROM spans s JOIN owners USING (secret), totals),
        kept AS (
            SELECT * FROM marked WHERE kind < 3
            UNION ALL
            SELECT m.* FROM marked m WHERE kind = 3 AND live AND NOT EXISTS (
                SELECT 1 FROM marked b WHERE b.doc_id = m.doc_id AND b.kind < 3 AND b.start < m.stop AND m.start < b.stop)),
        named AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS s FROM kept),
        by_doc AS (
            SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
                count(*) FILTER (kind = 2) AS n_hex, string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
                string_agg(s, ',' ORDER BY start, kind) AS spans, count(*) FILTER (kind < 3 AND live) AS n_live,
                count(*) FILTER (kind < 3 AND NOT live) AS n_example,
                max(n_repositories) AS most_repositories, max(n_owners) AS most_owners
            FROM named GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
            coalesce(n_example, 0) AS n_example, coalesce(most_repositories, 0) AS most_repositories, coalesce(most_owners, 0) AS most_owners
        FROM texts LEFT JOIN by_doc USING (doc_id)""",
    "op11_licenses": f"""
        WITH texts AS (
            SELECT row_number() OVER () AS row, doc_id, list_filter(
                string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{BETWEEN}'), lambda w: w <> '') AS w
            FROM documents),
        templates AS (SELECT * FROM (VALUES {_TEMPLATES}) t(template, label, tw, base, tolerance)),
        grams AS (SELECT template, tw[q + 1] AS t0, tw[q + 2] AS t1, q FROM (SELECT *, unnest(range(len(tw) - 1)) AS q FROM templates)),
        hits AS (
            SELECT row, template, p, q
            FROM (SELECT row, w[p + 1] AS a, w[p + 2] AS b, p FROM (SELECT *, unnest(range(len(w) - 1)) AS p FROM texts))
            JOIN grams ON a = t0 AND b = t1),
        diagonals AS (
            SELECT row, template, p - q AS diagonal, count(*) AS votes, min(p) AS first, max(p) AS last, list(q) AS qs
            FROM hits GROUP BY ALL),
        facts AS (SELECT *, len(tw) AS length FROM diagonals JOIN templates USING (template)),
        merged AS (
            SELECT row, label, length, diagonal, sum(votes) OVER w AS votes, min(first) OVER w AS start, max(last) OVER w + 2 AS stop,
                list_distinct(flatten(list(qs) OVER w)) AS qs, tolerance
            FROM facts WHERE NOT base AND votes >= {MIN_VOTES}
            WINDOW w AS (PARTITION BY row, template ORDER BY diagonal RANGE BETWEEN tolerance PRECEDING AND tolerance FOLLOWING)),
        strongest AS (
            SELECT *, max({{'v': votes, 'd': -diagonal}}) OVER (
                PARTITION BY row, label ORDER BY diagonal RANGE BETWEEN tolerance PRECEDING AND tolerance FOLLOWING) AS best
            FROM merged),
        covers AS (
            SELECT row, label, start, len(list_distinct(list_concat(qs, list_transform(qs, lambda q: q + 1)))) AS covered,
                greatest(length, stop - start) AS longer
            FROM strongest WHERE best = {{'v': votes, 'd': -diagonal}}),
        spans AS (
            SELECT row, label, true AS base, diagonal AS start, 1.0::DOUBLE AS score FROM facts WHERE base AND votes = length - 1
            UNION ALL
            SELECT row, label, false, start, covered / longer FROM covers WHERE 100 * covered >= {COVER} * longer),
        by_row AS (
            SELECT row, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
            FROM spans GROUP BY row)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
            coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM texts LEFT JOIN by_row USING (row)""",
    "op13_hard_negatives": """
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.x, r.x)::BIGINT AS score
            FROM usable a JOIN usable r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.positive_id,
            (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
            AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10""",
}
