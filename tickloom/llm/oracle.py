"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]"

LINE_DEDUP = rf"""WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, i AS pos, ls[i + 1] AS line FROM split, unnest(range(len(ls))) AS u(i)),
    b AS (SELECT * FROM l WHERE regexp_matches(line, '{_WORD}')),
    h AS (SELECT *, len(regexp_extract_all(line, '{_WORD}+')) AS n FROM b),
    c AS (SELECT doc_id, pos, line, n, lead(pos, 1) OVER w AS pos1, lead(line, 1) OVER w AS line1, n + lead(n, 1) OVER w AS n1,
        lead(pos, 2) OVER w AS pos2, lead(line, 2) OVER w AS line2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    runs AS (SELECT doc_id, pos, pos2 AS final, [line, line1, line2] AS key FROM c WHERE pos2 IS NOT NULL
      UNION ALL SELECT doc_id, pos, pos1, [line, line1] FROM c WHERE n1 >= 50
      UNION ALL SELECT doc_id, pos, pos, [line] FROM c WHERE n >= 50),
    later AS (SELECT doc_id, pos, final FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1),
    marked AS (SELECT l.*, EXISTS (SELECT 1 FROM later r WHERE r.doc_id = l.doc_id AND l.pos BETWEEN r.pos AND r.final) AS gone FROM l),
    counted AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
        count(*) FILTER (WHERE gone AND NOT before) AS n_runs, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
      FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS before FROM marked) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, md5(kept) AS kept_md5
    FROM documents LEFT JOIN counted USING (doc_id)"""

QUALITY_RULES = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM documents),
    g AS (SELECT doc_id, i, ws[i + 1:i + 8] AS gram FROM w, unnest(range(len(ws) - 7)) AS u(i)),
    r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
    c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(8) AS x(k) GROUP BY doc_id),
    m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
    f AS (SELECT *, n_words < 20 AS few, 100 * n_repeat_words > 30 * n_words AS repeats, 100 * n_symbols > 30 * n_words AS symbols,
        100 * n_dup_lines > 30 * n_lines AS dups, word_chars < 2 * n_words OR word_chars > 15 * n_words AS lengths FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR repeats AS base_failed,
      NOT (few OR repeats OR symbols OR dups OR lengths) AS kept,
      few::BIGINT + 2 * repeats::BIGINT + 4 * symbols::BIGINT + 8 * dups::BIGINT + 16 * lengths::BIGINT AS fail_bits FROM f"""

PHRASES = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang,
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d, unnest(ps) AS u(piece)),
    f AS MATERIALIZED (SELECT lang, w[i + 1:i + k] AS g, count(*) AS a FROM p, range(1, 6) AS x(k), unnest(range(len(w) - k + 1)) AS u(i) GROUP BY ALL),
    total AS (SELECT lang, sum(a) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT * FROM f WHERE len(g) > 1 AND a >= 100),
    inside AS (SELECT lang, g[i + 1:i + k] AS g, max(a) AS most FROM c, range(2, 5) AS x(k), unnest(range(len(g) - k + 1)) AS u(i) WHERE k < len(g) GROUP BY ALL),
    left_over AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, g) WHERE coalesce(100 * most < 100 * a, true)),
    cuts AS (SELECT c.lang, c.g, c.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
      FROM left_over c, unnest(range(1, len(c.g))) AS u(k), f l, f r, total t
      WHERE l.lang = c.lang AND l.g = c.g[1:k] AND r.lang = c.lang AND r.g = c.g[k + 1:] AND t.lang = c.lang),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
    SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (SELECT *, array_to_string(g, ' ') AS phrase,
      row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best) WHERE rank <= 2000"""


def _clustering(count: int, rounds: int) -> str:
    """One CTE for the assignment and one for the centroids of every round."""
    parts = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS m FROM v
        QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= {count})"""]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, v, c, d FROM (SELECT vec_id, v, c,
            list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{k})
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        parts.append(f"""c{k + 1} AS MATERIALIZED (WITH s AS (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, 65) AS x(i) GROUP BY c, i)
          SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s GROUP BY c UNION ALL SELECT c, m FROM c{k} WHERE c NOT IN (SELECT c FROM s))""")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts[:-1])}
    SELECT vec_id, {last}.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY {last}.c))::BIGINT AS cluster_inertia,
      (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} ON c{rounds}.c = {last}.c"""


CLUSTERING = _clustering(40, 5)

SQL = {"op5_line_dedup": LINE_DEDUP, "op9_quality_rules": QUALITY_RULES, "op11_phrase_collocations": PHRASES, "op13_centroid_clustering": CLUSTERING}
