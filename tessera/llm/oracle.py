"""DuckDB SQL of those queries that SQL can express over whole tables."""

from __future__ import annotations

from tessera.llm import licenses, quality

_W = r"[^\x20\x09-\x0D]+"

_FORM = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _canonical(text: str) -> str:
    out = f"translate({_FORM.format(text)}, '{licenses.TYPOGRAPHY}', '{' ' * len(licenses.TYPOGRAPHY)}')"
    for a, b in licenses.SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    out = f"regexp_replace({out}, '{licenses.TITLE}', '')"
    out = rf"regexp_replace(regexp_replace({out}, '{licenses.COPYRIGHT}', '\1', 'g'), '{licenses.RESERVED}', '', 'g')"
    return rf"trim(regexp_replace({out}, '[\x00-/:-@\[-`{{-\x7f]+', ' ', 'g'), ' ')"


_KNOWN = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEXTS.items())

SQL: dict[str, str] = {
    "op1_maxscore_topk": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, coalesce(list_sum(list_transform(list_zip(q.w, v.w), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
            FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op3_license_scan": f"""
        WITH lic AS (SELECT digest, min(id) AS license_id FROM (SELECT id, sha256({_canonical('body')}) AS digest FROM (VALUES {_KNOWN}) v(id, body)) GROUP BY digest),
        form AS (SELECT doc_id, {_canonical('text')} AS f FROM documents)
        SELECT doc_id, sha256(f) AS digest, length(f)::BIGINT AS canonical_chars, CASE WHEN length(f) > 0 THEN license_id END AS license_id
        FROM form LEFT JOIN lic ON lic.digest = sha256(f)""",
}

# Line rules of op7, on a line l with n words, solid characters s and symbols y.
_LINE = r"""CASE WHEN len(l) - len(replace(l, '|', '')) >= 3 THEN 'navigation' WHEN y > 0.08 * s THEN 'symbols'
    WHEN len(list_filter(w, lambda x: regexp_matches(x, '!!$'))) > 0.2 * len(w) THEN 'shouting'
    WHEN regexp_matches(l, '{nav}') THEN 'navigation' WHEN regexp_matches(l, '{boiler}') THEN 'boilerplate'
    WHEN len(w) >= 8 AND NOT regexp_matches(l, '[.!?;:…。！？]') THEN 'punctuation' END""".format(nav=quality.NAVIGATION, boiler=quality.BOILERPLATE)

SQL["op7_quality_rules"] = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
    l AS (SELECT doc_id, i, l, regexp_extract_all(l, '{_W}') AS w, len(translate(l, '\x20\x09\x0A\x0B\x0C\x0D', '')) AS s, len(l) - len(translate(l, '#*$%&|<>', '')) AS y
        FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM l WHERE len(w) > 0 GROUP BY 1),
    lost AS (SELECT doc_id, sum(len(w)) AS lost_words FROM l WHERE {_LINE} IS NOT NULL GROUP BY 1),
    win AS (SELECT doc_id, i, hash(w[i : i + 7]) AS h, w[i : i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
    twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    cover AS (SELECT doc_id, sum(least(8, coalesce(next - i, 8))) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY 1),
    a AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, (len(t) - len(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words
        FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id) LEFT JOIN cover USING (doc_id)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
    SELECT *, NOT base_failed AND lost_words <= 0.5 * n_words AS kept FROM b"""
