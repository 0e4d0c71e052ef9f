"""DuckDB SQL of the llm queries that SQL can express, in whole or for some of their columns."""

from __future__ import annotations

from millrace.llm.url_filter import DAMPING, LEAST_BLAME, ROUNDS, RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(c: str) -> str:
    return f"translate({c}, '{_UPPER}', '{_LOWER}')"


def _crc32(c: str) -> str:
    """crc32 of an ASCII text: each character is followed by eight shifts."""
    steps = f"flatten(list_transform(string_split(({c})::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"


EXACT = r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
        doc_id = first_value(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
    FROM d WINDOW g AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""


def urls() -> str:
    """Rules and the walks over host links, one common table a round."""
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.action}')" for r in RULES)
    link = r"""(?i)<a\s[^>]*?href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)"""
    ways = [("t", "source", "target", "source"), ("p", "source", "target", "source"), ("b", "target", "source", "source")]
    edges = " UNION ALL ".join(f"SELECT '{k}' AS kind, {of} AS host, {to} AS dest, n / sum(n) OVER (PARTITION BY {by}) AS w FROM links" for k, of, to, by in ways)
    rounds = "".join(
        f"""
        , r{i} AS (
            SELECT host, kind, seed, seed * {1 - DAMPING} + {DAMPING} * coalesce(arrived, 0.0) AS score
            FROM r{i - 1} LEFT JOIN (
                SELECT e.kind AS k, e.dest AS h, sum(e.w * s.score) AS arrived FROM edges e JOIN r{i - 1} s ON e.kind = s.kind AND e.host = s.host GROUP BY ALL
            ) ON k = kind AND h = host
        )"""
        for i in range(1, ROUNDS + 1)
    )
    return rf"""
        WITH p AS MATERIALIZED (
            SELECT page_id, html, {_low(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), fits AS (
            SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
            FROM p JOIN (VALUES {rules}) r(rhost, rpath, action) ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
            GROUP BY page_id
        ), judged AS MATERIALIZED (
            SELECT page_id, host, path, rule, action FROM p LEFT JOIN fits USING (page_id)
        ), links AS MATERIALIZED (
            SELECT source, target, count(*)::double AS n FROM (
                SELECT host AS source, regexp_replace({_low("t")}, '^.*@|:[0-9]*$', '', 'g') AS target
                FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS t FROM p)
            ) WHERE source <> target AND source <> '' AND target <> '' GROUP BY ALL
        ), seeds AS (
            SELECT host, count(*) FILTER (action = 'allow') / count(*) AS trust, count(*) FILTER (action = 'block') / count(*) AS distrust FROM judged GROUP BY host
        ), hosts AS (SELECT host FROM judged UNION SELECT source FROM links UNION SELECT target FROM links),
        edges AS MATERIALIZED ({edges}),
        r0 AS (
            SELECT host, kind, seed, seed * {1 - DAMPING} AS score FROM (
                SELECT host, unnest([{{'kind': 't', 'seed': coalesce(trust, 0.0)}}, {{'kind': 'p', 'seed': 1.0::double}}, {{'kind': 'b', 'seed': coalesce(distrust, 0.0)}}], recursive := true)
                FROM hosts LEFT JOIN seeds USING (host)
            )
        ){rounds}
        , marks AS (
            SELECT host, max(score) FILTER (kind = 't') / max(score) FILTER (kind = 'p') AS trusted, max(score) FILTER (kind = 'b') AS blame FROM r{ROUNDS} GROUP BY host
        )
        SELECT page_id, host, path, rule, coalesce(action, CASE WHEN blame > trusted AND blame >= {LEAST_BLAME} THEN 'block' ELSE 'allow' END) AS verdict
        FROM judged JOIN marks USING (host)
    """


_WORDS = rf"regexp_extract_all({_low("coalesce(text, '')")}, '[^\x20\x09-\x0D]+')"

#: n_tokens, n_known, train_tokens and the base score.
BASE_COUNTS = rf"""
    WITH d AS MATERIALIZED (SELECT doc_id, {_crc32("doc_id")} % 5 = 1 AS held_out, list_append({_WORDS}, '') AS tokens FROM documents),
    c AS MATERIALIZED (SELECT token, count(*) AS c FROM (SELECT unnest(tokens) AS token FROM d WHERE NOT held_out) GROUP BY token),
    t AS (SELECT coalesce(sum(c), 0)::bigint AS n, count(*) AS v FROM c)
    SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c.c > 0) AS n_known, any_value(t.n) AS train_tokens,
        round(sum(log10((coalesce(c.c, 0) + 0.5) / (t.n + 0.5 * (t.v + 1)))), 4) AS base_score
    FROM (SELECT doc_id, held_out, unnest(tokens) AS token FROM d) LEFT JOIN c USING (token), t GROUP BY doc_id, held_out
"""

#: Links on whole sets of four-word shingles, and what they reach.
NEAR = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS MATERIALIZED (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::varchar[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w
    ), e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
    links AS MATERIALIZED (
        SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS m, any_value(q.n) AS n, count(*) AS common FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2)
        WHERE 100 * common >= 80 * (m + n - common)
    ), reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT b, root FROM reach JOIN links ON a = id)
    SELECT doc_id, len(g)::bigint AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM s JOIN reach ON id = doc_id GROUP BY doc_id, g
"""

_PHRASES = "[{'p': ['gnu', 'general', 'public', 'license'], 'l': 'gpl'}, {'p': ['apache', 'license'], 'l': 'apache'}, {'p': ['cc', 'by'], 'l': 'cc-by'}, {'p': ['mit', 'license'], 'l': 'mit'}]"
#: The places and labels of the four phrases.
BASE_PHRASES = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    f AS (SELECT doc_id, w, x.l AS label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(x.p)] = x.p)) AS place FROM (SELECT doc_id, w, unnest({_PHRASES}) AS x FROM d))
    SELECT doc_id, len(d.w)::bigint AS n_words, count(place) AS n_base, coalesce(min(place), -1)::bigint AS first_word, coalesce(max(place), -1)::bigint AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
    FROM d LEFT JOIN (SELECT doc_id, label, place FROM f) f USING (doc_id) GROUP BY doc_id, d.w
"""

EDITS = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS after FROM d WINDOW w AS (ORDER BY doc_id DESC))
    SELECT doc_id, n::bigint AS n_chars, sha256(substring(t, 1, n - n // 2) || substring(after, 1, n // 2)) AS edited_sha256 FROM n
"""

FOLDS = rf"""
    SELECT doc_id, {_crc32("doc_id")} % 3 = 1 AS held_out, text IS NULL OR NOT regexp_matches(text, '\p{{L}}') AS without_letters FROM documents
"""
