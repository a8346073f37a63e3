"""DuckDB SQL for those queries of this subpackage that SQL can express, from the same constants."""

from __future__ import annotations

from . import jaccard, licenses, quality, shingles

def quality_sql() -> str:
    """Counts by brute force, then the sketches' quartiles and fences."""
    w, m, k = quality.WINDOW, list(quality.METRICS), quality.MILLI
    rate = lambda x, n, of: f"(({n} + {quality.SMOOTH[x][0]}) * 1000000 // ({of} + {quality.SMOOTH[x][1]}))"
    metric = {"symbol_ppm": rate("symbol_ppm", "n_symbols", "word_chars"), "dup_line_ppm": rate("dup_line_ppm", "n_dup_lines", "n_lines"), "repeat_ppm": rate("repeat_ppm", "n_repeat_words", "n_words"), "word_milli": "word_chars * 1000 // greatest(n_words, 1)"}
    shift = lambda v: f"greatest(length(bin({v})) - {quality.DIGITS}, 0)"
    bucket = lambda v: f"({shift(v)} * {1 << quality.DIGITS - 1} + ({v} >> {shift(v)}))"

    def level(keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""SELECT {by}metric, any_value(total) AS n_, min(CASE WHEN upto * 4 >= total THEN bucket END) * {k} AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) * {k} AS q3 FROM (
    SELECT *, sum(n) OVER (PARTITION BY {by}metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}metric) AS total FROM (SELECT {by}metric, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL"""

    def drawn(own: str, above: str, keys: str) -> str:
        mean = lambda q: f"((o.{q} * o.n_ + a.{q} * {quality.PRIOR}) // (o.n_ + {quality.PRIOR}))"
        return f"SELECT o.* EXCLUDE (q1, q3), {mean('q1')} AS q1, {mean('q3')} AS q3, CASE WHEN o.q1 = o.q3 THEN a.spread ELSE {mean('q3')} - {mean('q1')} END AS spread FROM {own} o JOIN {above} a USING ({keys}metric)"

    lines = "list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"
    fences, inside = [], []
    for x, low in quality.METRICS.items():
        for name, low_end in ((f"{x}_hi", False), (f"{x}_lo", True)):
            if low_end and not low:
                continue
            value = f"q1 - {quality.FENCE} * spread" if low_end else f"q3 + {quality.FENCE} * spread"
            fences.append(f"max(CASE WHEN metric = '{x}' AND spread > 0 THEN {value} END) AS {name}")
            inside.append(f"coalesce({bucket(x)} * {k} {'>=' if low_end else '<='} {name}, true)")
    failed = f"(n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)"
    return f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
wins AS (SELECT doc_id, i, array_to_string(words[i:i + {w - 1}], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - {w - 2})) AS i FROM t)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n >= 2),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {w})) AS p FROM twice) GROUP BY ALL),
base AS (SELECT t.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len({lines})::BIGINT AS n_lines, (len({lines}) - len(list_distinct({lines})))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN covered c USING (doc_id)),
feats AS (SELECT *, {', '.join(f'({metric[x]})::BIGINT AS {x}' for x in m)} FROM base),
long AS ({' UNION ALL '.join(f"SELECT lang, source, '{x}' AS metric, {x} AS v FROM feats" for x in m)}),
sketch AS (SELECT lang, source, metric, {bucket('v')} AS bucket, count(*) AS n FROM long GROUP BY ALL),
every_ AS (SELECT *, q3 - q1 AS spread FROM ({level('')})), lang_own AS ({level('lang')}), own AS ({level('lang, source')}),
lang_ AS ({drawn('lang_own', 'every_', '')}), group_ AS ({drawn('own', 'lang_', 'lang, ')}),
limits AS (SELECT lang, source, {', '.join(fences)} FROM group_ GROUP BY ALL)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND {' AND '.join(inside)} AS kept, n_lines, {', '.join(m)}
FROM feats f JOIN limits l USING (lang, source)"""


def license_sql() -> str:
    rows = []
    for t, (text, label) in enumerate((*licenses.PHRASES, *licenses.TEMPLATES)):
        w = text.split(" ")
        n = len(w) - licenses.K + 1
        rows += [f"({t}, '{label}', {str(t < len(licenses.PHRASES)).lower()}, {n}, {p}, '{' '.join(w[p:p + licenses.K])}')" for p in range(n)]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH tpl(t_id, label, exact, n_grams, t_pos, gram) AS (VALUES {', '.join(rows)}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
grams AS (SELECT doc_id, i - 1 AS pos, array_to_string(words[i:i + {licenses.K - 1}], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - {licenses.K - 2})) AS i FROM w)),
hits AS (SELECT doc_id, t_id, label, exact, n_grams, t_pos, pos, pos - t_pos AS diagonal FROM grams JOIN tpl USING (gram)),
steps AS (SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t_id ORDER BY diagonal) > {licenses.NEIGHBOURS} THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT doc_id, t_id, exact, diagonal FROM hits)),
runs AS (SELECT doc_id, t_id, diagonal, sum(new) OVER (PARTITION BY doc_id, t_id ORDER BY diagonal) AS run FROM steps),
copies AS (SELECT h.doc_id, h.t_id, r.run, any_value(label) AS label, any_value(exact) AS exact, min(h.diagonal) AS diagonal, count(DISTINCT t_pos) AS found, any_value(n_grams) AS n_grams, min(pos) AS lo, max(pos) + {licenses.K} AS end_, len(list_distinct(flatten(list(range(pos, pos + {licenses.K}))))) AS agreed FROM hits h JOIN runs r USING (doc_id, t_id, diagonal) GROUP BY h.doc_id, h.t_id, r.run),
good AS (SELECT *, found::DOUBLE / n_grams::DOUBLE AS part FROM copies WHERE CASE WHEN exact THEN found = n_grams ELSE found::DOUBLE / n_grams::DOUBLE >= {licenses.COVERAGE} AND agreed >= {licenses.COVERAGE} * (end_ - lo) END),
by_doc AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(diagonal) FILTER (exact) AS first_word, max(diagonal) FILTER (exact) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS score,
  array_to_string(list_sort(list_distinct(list(lpad(lo::VARCHAR, 9, '0') || ':' || end_ || ':' || label))), ',') AS spans FROM good GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(spans, '') AS spans FROM w LEFT JOIN by_doc USING (doc_id)"""


def jaccard_sql() -> str:
    """Brute force: every pair of documents that share a shingle."""
    n = shingles.N
    return f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 2}, least(len(w), 1) + 1))) AS i FROM t)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY ALL),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b, both_ = x.n AND both_ = y.n AS same FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE both_ >= {jaccard.THRESHOLD} * (x.n + y.n - both_) - 1e-9),
arcs AS (SELECT a, b, same FROM near UNION ALL SELECT b, a, same FROM near),
reach(doc_id, root) AS (SELECT DISTINCT a, a FROM arcs UNION SELECT arcs.b, reach.root FROM reach JOIN arcs ON arcs.a = reach.doc_id),
comp AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY ALL),
links AS (SELECT a AS doc_id, count(*) AS n_links, min(b) FILTER (same) AS least FROM arcs GROUP BY ALL)
SELECT t.doc_id, coalesce(c.class_id, t.doc_id)::BIGINT AS class_id, least(t.doc_id, coalesce(l.least, t.doc_id))::BIGINT AS copy_id, coalesce(l.n_links, 0)::BIGINT AS n_links FROM t LEFT JOIN comp c USING (doc_id) LEFT JOIN links l USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_sql(), "op4_license_scan": license_sql(), "op8_jaccard_join": jaccard_sql()}
