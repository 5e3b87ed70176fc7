"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from tidemark.llm import quality

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WS_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ITEM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

MIXING = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1), w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM s),
 -- with the k sources of least size to weight full, the level of the rest; the first that none of the rest falls under
 o AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS total FROM w),
 l AS (SELECT k, (total - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, most / weight AS ratio FROM o),
 v AS (SELECT level FROM l WHERE level <= ratio ORDER BY k LIMIT 1), g AS (SELECT source, source_size, least(most, weight * level) AS target FROM w, v),
 r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(size::DOUBLE)), substr(md5(CAST(doc_id AS VARCHAR)), 1, 2), size, doc_id) - 1 AS row FROM d),
 x AS (SELECT doc_id, size, source_size, target, row, least(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END, 2.0::DOUBLE) AS rate, CAST('0x' || substr(md5('17:' || coalesce('=' || r.source, 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source)
 SELECT doc_id, size, source_size, target, CAST(greatest(0, least(floor(row * rate + rate + u) - floor(row * rate + u), ceil(rate))) AS BIGINT) * size AS taken FROM x"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {WS_WORDS.format(LOWER)} AS ws FROM documents),
 g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') || ' <' ELSE array_to_string(ws[i : i + 3], ' ') END AS gram FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) t(i) WHERE len(ws) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 c(doc_id, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, c.label FROM c JOIN u ON u.a = c.doc_id WHERE c.label < u.b)
 SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, m.label AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(label) AS label FROM c GROUP BY 1) m ON m.doc_id = d.doc_id"""

CONTAMINATION = f"""WITH w AS (SELECT doc_id, {ITEM_WORDS.format(LOWER)} AS ws FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item, {ITEM_WORDS.format(LOWER)} AS ws FROM benchmark),
 k AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[j : j + 9], ' ') AS win FROM i, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(j) WHERE len(ws) > 0), ns AS (SELECT DISTINCT n FROM k),
 p AS (SELECT doc_id, n, j, array_to_string(ws[j : j + n - 1], ' ') AS win FROM w, ns, unnest(range(1, greatest(len(ws) - n + 1, 0) + 1)) t(j)), h AS (SELECT DISTINCT doc_id, p.n AS n, j, item FROM p JOIN k ON p.win = k.win AND p.n = k.n),
 c AS (SELECT doc_id, count(DISTINCT j + o) AS n_hit FROM h, unnest(range(0, n)) t(o) GROUP BY 1), s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
 SELECT w.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN s ON s.doc_id = w.doc_id"""

SUFFIX = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), b AS (SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes FROM t),
 p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM t, unnest(range(0, greatest(length(h) // 2 - 199, 0))) u(i)), r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS m FROM p) WHERE m > 1),
 g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)), s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
 q AS (SELECT doc_id, span, min(i) AS low, max(i) + 200 AS high FROM s GROUP BY 1, 2), e AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM q),
 k AS (SELECT e.doc_id AS doc_id, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) || substr(any_value(h), 2 * max(high) + 1) AS rest FROM e JOIN t ON t.doc_id = e.doc_id GROUP BY 1)
 SELECT t.doc_id AS doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM t JOIN b ON b.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = t.doc_id"""

COLLOCATIONS = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p), n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
 f AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM w, unnest(range(1, 6)) t(k), unnest(range(1, greatest(len(ws) - k + 2, 1))) u(i) GROUP BY ALL HAVING count(*) >= 100),
 c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
 s AS (SELECT c.lang, c.phrase, a, j, x.f AS l, y.f AS r, n, CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM c, unnest(range(1, c.k)) t(j) JOIN n ON n.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1 : c.k], ' ')),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
 i AS (SELECT lang, array_to_string(ws[o : o + m - 1], ' ') AS phrase, max(a) AS most FROM c, unnest(range(2, k)) t(m), unnest(range(1, k - m + 2)) u(o) GROUP BY 1, 2),
 d AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR 100 * most < 100 * a)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d QUALIFY rank <= 2000"""


def _quality() -> str:
    bands = " ".join(f"WHEN n_words >= {low} THEN {k}" for k, low in reversed(list(enumerate(quality.BANDS))))
    rates = ", ".join(f"CAST(least({units} * {part} // greatest({whole}, 1), {quality.TOP}) AS INT) AS {rate}" for rate, (part, whole, units) in quality.RATES.items())
    least, risk = quality.DELTA / (len(quality.BANDS) * len(quality.RATES)), quality.RISK
    tail = f"sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN n = i THEN 0 ELSE lgamma(n - i + 1) END + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})))"
    steps, before = "", "h0"
    for k, rate in enumerate(quality.RATES):
        cuts = " UNION ".join(f"SELECT stratum, min({rate}) FILTER (1000 * upto >= {level} * whole) AS cut FROM q{k} GROUP BY 1" for level in quality.LEVELS)
        steps += f""",
 q{k} AS (SELECT stratum, {rate}, sum(count(*)) OVER (PARTITION BY stratum ORDER BY {rate}) AS upto, sum(count(*)) OVER (PARTITION BY stratum) AS whole FROM m WHERE NOT base_failed GROUP BY stratum, {rate}), g{k} AS ({cuts}),
 f{k} AS (SELECT stratum, cut, count(*) AS n, count(*) FILTER (gone OR {rate} > cut) AS k FROM {before} JOIN g{k} USING (stratum) GROUP BY 1, 2), p{k} AS (SELECT stratum, cut, {tail} AS tail FROM f{k}, unnest(range(0, k + 1)) u(i) GROUP BY 1, 2),
 y{k} AS (SELECT stratum, cut, max(tail) OVER (PARTITION BY stratum ORDER BY cut DESC) AS worst FROM p{k}), z{k} AS (SELECT stratum, min(cut) AS cut FROM y{k} WHERE worst <= {least!r} GROUP BY 1),
 h{k + 1} AS (SELECT h.* EXCLUDE (gone), gone OR coalesce({rate} > cut, false) AS gone FROM {before} h LEFT JOIN z{k} USING (stratum))"""
        before = f"h{k + 1}"
    gone = " OR ".join(f"coalesce({rate} > (SELECT cut FROM z{k} WHERE z{k}.stratum = m.stratum), false)" for k, rate in enumerate(quality.RATES))
    return rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WS_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
 l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
 t AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM w, unnest(range(1, greatest(len(ws) - 2, 0) + 1)) u(i)), r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS m FROM t) WHERE m > 1),
 c AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, unnest(range(0, 3)) v(o) GROUP BY 1),
 b AS (SELECT w.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id),
 m AS (SELECT *, CASE {bands} ELSE 0 END AS stratum, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rates} FROM b),
 h0 AS (SELECT m.*, false AS gone FROM m JOIN labels ON labels.doc_id = m.doc_id WHERE quality = 1 AND NOT base_failed){steps}
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({gone}) AS kept FROM m"""


SQL = {"op5_mixing": MIXING, "op6_jaccard_join": JACCARD, "op7_decontamination": CONTAMINATION, "op8_quality": _quality(), "op10_suffix_dedup": SUFFIX, "op12_collocations": COLLOCATIONS}
