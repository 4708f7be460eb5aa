"""SQL counterparts of the core queries, for DuckDB over the same tables."""

from __future__ import annotations

from lexiloom.functions.tables import VIETNAMESE_LETTERS
from lexiloom.operators.parse_rows import MARKS, MARKS_ANY_CASE
from lexiloom.plans.queries import FUZZY, LOOKUPS, MISSPELT, SEARCHES

_BLANK = r"[\t-\r\x1c-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]+"


def _tokens(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{Nd}}]+')"


def _fold(text: str) -> str:
    return f"strip_accents(replace(replace({text}, 'đ', 'd'), 'Đ', 'D'))"


def _collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_BLANK}', ' ', 'g'))"


def _norm(text: str) -> str:
    bare = rf"regexp_replace(regexp_replace(coalesce({text}, ''), '^\x{{FEFF}}', ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
    return f"nfc_normalize(lower({_collapse(f'''replace({bare}, '_', ' ')''')}))"


def _values(rows: tuple) -> str:
    return ", ".join(f"({i}, '{q}')" for i, q in rows)


def _alternatives(gloss: str) -> str:
    bare = rf"regexp_replace(regexp_replace({gloss}, '\([^)]*\)', ' ', 'g'), '\[[^\]]*\]', ' ', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({bare}, '[,;]'), lambda a: {_collapse('a')}), lambda a: a <> '')"


def _trigrams(text: str) -> str:
    return f"CASE WHEN length({text}) > 0 THEN list_transform(range(1, length({text}) + 3), lambda i: substr('$$' || {text} || '$$', i, 3)) ELSE [] END"


_DOCS = f"docs AS (SELECT doc_id, {_tokens('''coalesce(text, '')''')} AS tokens FROM documents), tok AS (SELECT doc_id, unnest(tokens) AS term FROM docs)"
_FOLDED = f"docs AS (SELECT doc_id, {_tokens(_fold('''coalesce(text, '')'''))} AS tokens FROM documents), tok AS (SELECT doc_id, unnest(tokens) AS term FROM docs)"
_GLOSS = "gl AS (SELECT entry_id, unnest(s.glosses) AS gloss FROM (SELECT entry_id, unnest(senses) AS s FROM entries))"
_ALL_GLOSS = "ag AS (SELECT unnest(s.glosses) AS gloss FROM (SELECT unnest(senses) AS s FROM entries) UNION ALL SELECT unnest(s.glosses) FROM (SELECT unnest(idioms) AS s FROM entries))"
_COMPOUNDS = rf"""{_ALL_GLOSS}, alt AS (SELECT unnest({_alternatives('lower(gloss)')}) AS compound FROM ag WHERE gloss IS NOT NULL),
 comp AS (SELECT compound, count(*) AS n FROM alt WHERE regexp_full_match(compound, '\p{{L}}+( \p{{L}}+){{1,2}}') GROUP BY 1 HAVING count(*) >= 3)"""
_KEYS = f"""ip AS (SELECT entry_id, headword_norm, source_id, source_line, unnest(range(0, len(idioms))) AS idiom_no, unnest(idioms) AS i FROM entries),
 ik AS (SELECT *, {_norm('i.phrase')} AS k FROM ip), ib AS (SELECT *, CASE WHEN starts_with(k, 'to ') THEN substr(k, 4) ELSE k END AS bare FROM ik WHERE k <> ''),
 cand AS (SELECT *, 0 AS form, k AS key FROM ib UNION ALL SELECT *, 1 AS form, bare AS key FROM ib WHERE bare <> k),
 ranked AS (SELECT key, entry_id, row_number() OVER (PARTITION BY key ORDER BY (split_part(bare, ' ', 1) <> headword_norm)::int, headword_norm, source_id, source_line, entry_id, idiom_no, form) AS r FROM cand WHERE key <> ''),
 alias AS (SELECT key, entry_id FROM ranked WHERE r = 1 AND key NOT IN (SELECT headword_norm FROM entries WHERE headword_norm <> '')),
 keys AS (SELECT headword_norm AS key, entry_id FROM entries WHERE headword_norm <> '' UNION ALL SELECT key, entry_id FROM alias)"""
_LOOKUP = f"asked AS (SELECT query_id, {_norm('query')} AS key FROM (VALUES {_values(LOOKUPS)}) v(query_id, query))"
_LOG = r"lg AS (SELECT epoch_second, mode, q AS query FROM (SELECT epoch_second, mode, substr(trim(regexp_replace(query, '[\t\r\n]+', ' ', 'g')), 1, 5000) AS q FROM lookup_history) WHERE epoch_second IS NOT NULL AND length(mode) > 0 AND regexp_matches(q, '[^ \t\n\x0b\f\r]'))"
_CATALOG = "CASE WHEN c.id IS NULL THEN 2147483647 ELSE c.priority END"


def _bm25(docs: str, query: str) -> str:
    return f"""WITH {docs}, asked AS (SELECT query_id, unnest(list_distinct({_tokens(query)})) AS term FROM (VALUES {_values(SEARCHES)}) v(query_id, query)),
 st AS (SELECT count(*) AS n, greatest(1.0, avg(len(tokens))) AS a FROM docs), dl AS (SELECT doc_id, len(tokens) AS l FROM docs),
 tf AS (SELECT term, doc_id, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.8::DOUBLE + 0.2::DOUBLE * l / a))), 6) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id) JOIN asked USING (term), st GROUP BY 1, 2)
 SELECT query_id, doc_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank FROM sc) WHERE rank <= 10"""


def _top(inner: str, k: int, tie: str) -> str:
    return f"SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie}))::INT AS rank FROM ({inner})) WHERE rank <= {k}"


_PAIRS = r"""p AS (SELECT line_no, regexp_extract_all(lower(en), '[\p{L}\p{Nd}'']+') AS en, regexp_extract_all(lower(vi), '[\p{L}\p{Nd}]+') AS vi FROM parallel_pairs),
 u AS (SELECT * FROM p WHERE len(en) BETWEEN 1 AND 20 AND len(vi) BETWEEN 1 AND 20),
 es AS (SELECT line_no, unnest(list_prepend('', en)) AS e FROM u), fs AS (SELECT line_no, unnest(vi) AS f FROM u),
 ec AS (SELECT line_no, e, count(*) AS ne FROM es GROUP BY 1, 2), fc AS (SELECT line_no, f, count(*) AS nf FROM fs GROUP BY 1, 2),
 cells AS (SELECT * FROM ec JOIN fc USING (line_no))"""


_TOP = """pt AS (SELECT e, f, round(t, 6) AS p FROM t4 WHERE round(t, 6) >= 0.005 AND e <> ''), rt AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY p DESC, f) AS rank FROM pt),
 top AS (SELECT e, f, rank, greatest(0, least(65535, round(p * 65535.0::DOUBLE)))::INT AS q FROM rt WHERE rank <= 16)"""
_ENGLISH = r"""ph AS (SELECT headword_norm AS p FROM entries UNION ALL SELECT unnest(list_transform(idioms, lambda i: i.phrase)) FROM entries),
 ew AS (SELECT unnest(regexp_extract_all(lower(p), '[\p{L}\p{Nd}'']+')) AS word FROM ph), envoc AS (SELECT DISTINCT word FROM ew WHERE regexp_full_match(word, '[a-z'']{1,30}'))"""
_VIETNAMESE = f"{_ALL_GLOSS}, vw AS (SELECT unnest({_tokens('gloss')}) AS word FROM ag WHERE gloss IS NOT NULL), vivoc AS (SELECT DISTINCT word FROM vw)"


def _em(iterations: int, vocabulary: bool = False, whole: bool = False) -> str:
    pairs = _PAIRS.replace("BETWEEN 1 AND 20", ">= 1") if whole else _PAIRS
    if vocabulary:
        pairs = f"{_ENGLISH}, {_VIETNAMESE}, {pairs}".replace("SELECT line_no, unnest(list_prepend('', en)) AS e FROM u", "SELECT line_no, coalesce(word, '') AS e FROM (SELECT line_no, unnest(list_prepend('', en)) AS w FROM u) LEFT JOIN envoc ON word = w")
        pairs = pairs.replace("SELECT line_no, unnest(vi) AS f FROM u", "SELECT line_no, coalesce(word, '') AS f FROM (SELECT line_no, unnest(vi) AS w FROM u) LEFT JOIN vivoc ON word = w")
    out = f"WITH {pairs}, t0 AS (SELECT DISTINCT e, f, 1.0::DOUBLE AS t FROM cells)"
    for i in range(iterations):
        out += f""", x{i} AS (SELECT e, f, nf * ne * t / sum(ne * t) OVER (PARTITION BY line_no, f) AS c FROM cells JOIN t{i} USING (e, f)),
 c{i} AS (SELECT e, f, sum(c) AS c FROM x{i} GROUP BY 1, 2), t{i + 1} AS (SELECT e, f, c / sum(c) OVER (PARTITION BY e) AS t FROM c{i})"""
    return out


def _parse() -> str:
    marks = ", ".join("'" + m.replace("'", "''") + "'" for m in MARKS_ANY_CASE)
    exact = ", ".join("'" + m + "'" for m in MARKS)
    plain = r'[^\t"D][^\t]*'.replace("D", r"\x{FDD0}")
    quoted = r'\x{FDD0}*"[^"]*"|\x{FDD0}+'
    field = rf"(?:{quoted}|{plain}|)"
    bad = r"[\x00-\x08\x0a-\x1f\x7f-\x9f\x{FFFD}]"
    value = lambda i: f"CASE WHEN regexp_full_match(list_extract(f, {i}), '{quoted}') THEN replace(substr(replace(list_extract(f, {i}), '{chr(0xFDD0)}', '\"\"'), 2, length(replace(list_extract(f, {i}), '{chr(0xFDD0)}', '\"\"')) - 2), '\"\"', '\"') ELSE replace(list_extract(f, {i}), '{chr(0xFDD0)}', '\"\"') END"
    wrong = lambda v: rf"NOT regexp_matches({v}, '[\p{{L}}\p{{N}}]') OR regexp_matches({v}, '{bad}')"
    return rf"""WITH a AS (SELECT line_id, replace(regexp_replace(regexp_replace(raw_line, '^\x{{FEFF}}', ''), '\r$', ''), '""', '{chr(0xFDD0)}') AS t FROM tsv_lines),
 b AS (SELECT * FROM a WHERE t IS NOT NULL AND regexp_matches(t, '[^\t-\r \p{{Z}}]') AND NOT starts_with(t, '#')),
 c AS (SELECT *, regexp_full_match(t, '{field}(?:\t{field})*') AS whole, list_transform(regexp_extract_all(chr(9) || t, '\t({field})'), lambda x: substr(x, 2)) AS f FROM b),
 d AS (SELECT line_id, whole, len(f) AS n, {value(1)} AS h, {value(2)} AS g, {value(3)} AS p FROM c),
 r AS (SELECT line_id, h, g, p, CASE WHEN NOT whole THEN 'broken_quote' WHEN n NOT BETWEEN 2 AND 3 THEN 'column_count'
  WHEN {wrong('h')} OR {wrong('g')} OR lower(trim(regexp_replace(g, '^[ \p{{Z}}\x0b\f]+|[ \p{{Z}}\x0b\f]+$', '', 'g'))) IN ({marks}) OR trim(g) IN ({exact}) THEN 'bad_value' END AS reason FROM d)"""


SQL: dict[str, str] = {
    "p4_found": f"{_parse()} SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p4_rows": rf"{_parse()} SELECT line_id, h AS headword, g AS gloss, CASE WHEN regexp_matches(p, '[^\t-\r \p{{Z}}]') THEN p END AS pos FROM r WHERE reason IS NULL",
    "tokens_count": f"WITH {_DOCS} SELECT count(*) AS tokens, count(DISTINCT term) AS terms FROM tok",
    "term_frequency": f"WITH {_DOCS} SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2",
    "doc_frequency_idf": f"WITH {_DOCS}, d AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1) SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM d, (SELECT count(*) AS n FROM documents)",
    "doc_length_stats": f"WITH {_DOCS} SELECT count(*) AS docs, round(avg(len(tokens)), 6) AS avg_len, max(len(tokens)) AS max_len FROM docs",
    "bm25_search": _bm25(_DOCS, "query"),
    "bm25_accent_free_search": _bm25(_FOLDED, _fold("query")),
    "accent_fold_vocab": f"WITH {_DOCS} SELECT {_fold('term')} AS folded, count(DISTINCT term) AS forms FROM tok GROUP BY 1",
    "normalize_headword": f"SELECT entry_id, {_norm('headword')} AS norm FROM entries",
    "gloss_alternatives": f"WITH {_GLOSS}, a AS (SELECT unnest({_alternatives('gloss')}) AS alternative FROM gl WHERE gloss IS NOT NULL) SELECT alternative, count(*) AS n FROM a GROUP BY 1",
    "trigram_postings": f"WITH g AS (SELECT entry_id AS doc_id, unnest({_trigrams('headword_norm')}) AS term FROM entries) SELECT term, doc_id, count(*) AS tf FROM g GROUP BY 1, 2",
    "fuzzy_match_jaccard": f"""WITH q AS (SELECT query_id, lower(query) AS q FROM (VALUES {_values(FUZZY)}) v(query_id, query)), qg AS (SELECT query_id, unnest({_trigrams('q')}) AS gram, length(q) + 2 AS qn FROM q), qt AS (SELECT query_id, gram, any_value(qn) AS qn, count(*) AS qtf FROM qg GROUP BY 1, 2),
 h AS (SELECT headword_norm, min(entry_id) AS doc_id FROM entries WHERE headword_norm <> '' GROUP BY 1), hg AS (SELECT doc_id, headword_norm, length(headword_norm) + 2 AS dn, unnest({_trigrams('headword_norm')}) AS gram FROM h), ht AS (SELECT doc_id, headword_norm, gram, any_value(dn) AS dn, count(*) AS dtf FROM hg GROUP BY 1, 2, 3),
 m AS (SELECT query_id, doc_id, headword_norm, sum(least(qtf, dtf)) AS m, any_value(qn) AS qn, any_value(dn) AS dn FROM qt JOIN ht USING (gram) GROUP BY 1, 2, 3) {_top('SELECT query_id, doc_id, headword_norm, round(m / (qn + dn - m), 6) AS score FROM m', 10, 'doc_id')}""",
    "compound_mining": f"WITH {_COMPOUNDS} SELECT compound, n FROM comp",
    "did_you_mean": f"""WITH {_COMPOUNDS}, kn AS (SELECT compound, {_fold('compound')} AS folded FROM comp), q AS (SELECT query_id, {_fold('lower(query)')} AS q FROM (VALUES {_values(MISSPELT)}) v(query_id, query)),
 a AS (SELECT * FROM q WHERE contains(q, ' ') AND q NOT IN (SELECT folded FROM kn)), qg AS (SELECT query_id, list_distinct({_trigrams('q')}) AS g FROM a), wg AS (SELECT compound, list_distinct({_trigrams('folded')}) AS g FROM kn),
 s AS (SELECT query_id, compound, len(list_intersect(qg.g, wg.g)) AS m, len(qg.g) AS qn, len(wg.g) AS wn FROM qg, wg) {_top('SELECT query_id, compound, round(m / (qn + wn - m), 6) AS score FROM s WHERE m / (qn + wn - m) >= 0.5', 5, 'compound')}""",
    "compound_expand": f"""WITH {_DOCS}, {_COMPOUNDS}, g AS (SELECT tokens, unnest(range(1, len(tokens) + 1)) AS pos FROM docs), n AS (SELECT array_to_string(tokens[pos:pos + 1], ' ') AS compound FROM g WHERE pos + 1 <= len(tokens) UNION ALL SELECT array_to_string(tokens[pos:pos + 2], ' ') FROM g WHERE pos + 2 <= len(tokens))
 SELECT replace(compound, ' ', '_') AS term, count(*) AS n FROM n WHERE compound IN (SELECT compound FROM comp) GROUP BY 1""",
    "alias_keys": f"WITH {_KEYS} SELECT key, entry_id FROM alias",
    "exact_lookup": f"WITH {_KEYS}, {_LOOKUP} SELECT query_id, key, arg_min(entry_id, (headword_norm, source_id, source_line, entry_id)) AS entry_id FROM asked JOIN keys USING (key) JOIN entries USING (entry_id) GROUP BY 1, 2",
    "homograph_lookup": f"WITH {_KEYS}, {_LOOKUP} SELECT query_id, key, entry_id FROM asked JOIN keys USING (key)",
    "key_containment": f"WITH {_KEYS} SELECT DISTINCT {_norm('query')} AS key FROM lookup_history WHERE {_norm('query')} IN (SELECT key FROM keys)",
    "prefix_scan": f"WITH {_KEYS} SELECT key, entry_id FROM keys WHERE starts_with(key, 'ga') ORDER BY key, entry_id LIMIT 50",
    "phrase_starters": f"WITH {_KEYS} SELECT DISTINCT split_part(key, ' ', 1) AS starter FROM keys WHERE contains(key, ' ')",
    "candidate_ranking": f"""WITH k AS (SELECT count(*) FILTER (enabled = 1) > 0 AS on_ FROM dict_sources), r AS (SELECT e.*, {_CATALOG} AS prio FROM entries e LEFT JOIN dict_sources c ON c.id = e.source_id WHERE coalesce(c.enabled = 1, true)),
 s AS (SELECT headword_norm, entry_id, source_id, source_line, prio, unnest(range(0, len(senses))) AS sense_no, unnest(senses) AS s FROM r),
 g AS (SELECT *, coalesce(len(s.glosses), 0) + coalesce(len(s.examples), 0) - least(prio, 100) * 1000 AS w, unnest(range(0, len(s.glosses))) AS gloss_no, unnest(s.glosses) AS gloss FROM s),
 o AS (SELECT *, round(w - 0.01::DOUBLE * gloss_no, 6) AS score FROM g)
 SELECT headword_norm, rank, entry_id, gloss, score FROM (SELECT *, (row_number() OVER (PARTITION BY headword_norm ORDER BY (gloss_no > 0)::int, score DESC, prio, source_id, source_line, entry_id, sense_no, gloss_no))::INT AS rank FROM o) WHERE rank <= 12""",
    "phrase_candidates": f"""WITH {_KEYS}, m AS (SELECT a.key, ik.* FROM alias a JOIN ik USING (entry_id) WHERE ik.k = a.key OR ik.k = 'to ' || a.key),
 g AS (SELECT key, headword_norm, source_id, source_line, entry_id, idiom_no, unnest(range(0, len(i.glosses))) AS gloss_no, unnest(i.glosses) AS gloss FROM m),
 r AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY headword_norm, source_id, source_line, entry_id, idiom_no, gloss_no))::INT AS rank FROM g) SELECT key, rank, gloss, round(pow(0.95::DOUBLE, rank - 1), 6) AS score FROM r WHERE rank <= 12""",
    "source_filter_priority": f"SELECT entry_id, source_id, {_CATALOG} AS source_priority FROM entries e LEFT JOIN dict_sources c ON c.id = e.source_id WHERE coalesce(c.enabled = 1, true)",
    "source_all_disabled": "SELECT source_id, count(*) AS n FROM entries GROUP BY 1",
    "source_reorder": "WITH o AS (SELECT id, row_number() OVER (ORDER BY priority, id) - 1 AS i FROM dict_sources), m AS (SELECT i AS place FROM o WHERE id = 5) SELECT id, (CASE WHEN i = place THEN place - 2 WHEN i BETWEEN place - 2 AND place - 1 THEN i + 1 ELSE i END)::INT AS priority FROM o, m",
    "dictionary_stats": """SELECT count(*) AS entries, count(*) FILTER (contains(headword_norm, ' ')) AS multiword, sum(coalesce(len(senses), 0))::BIGINT AS senses,
 (sum(coalesce(list_sum(list_transform(senses, lambda s: coalesce(len(s.glosses), 0))), 0)) + sum(coalesce(list_sum(list_transform(idioms, lambda s: coalesce(len(s.glosses), 0))), 0)))::BIGINT AS glosses,
 (sum(coalesce(list_sum(list_transform(senses, lambda s: coalesce(len(s.examples), 0))), 0)) + sum(coalesce(list_sum(list_transform(idioms, lambda s: coalesce(len(s.examples), 0))), 0)))::BIGINT AS examples, sum(coalesce(len(idioms), 0))::BIGINT AS idioms FROM entries""",
    "looks_vietnamese": f"SELECT doc_id, coalesce(regexp_matches(lower(text), '[{VIETNAMESE_LETTERS}]'), false) AS vietnamese FROM documents",
    "latest_per_key_history": f"WITH {_LOG} SELECT mode, query, max(epoch_second) AS epoch_second, count(*) AS times FROM lg GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1000",
    "consecutive_dedupe": f"WITH {_LOG}, d AS (SELECT DISTINCT * FROM lg), b AS (SELECT *, lag((mode, query)) OVER (ORDER BY epoch_second, mode, query) AS b FROM d) SELECT epoch_second, mode, query FROM b WHERE b IS NULL OR b <> (mode, query)",
    "history_retention": f"WITH {_LOG}, n AS (SELECT count(*) AS n FROM lg), r AS (SELECT *, row_number() OVER (ORDER BY epoch_second DESC, mode, query) AS r FROM lg) SELECT epoch_second, mode, query FROM r, n WHERE n <= 2000 OR r <= 1000",
    "history_delete_key": f"WITH {_LOG} SELECT * FROM lg WHERE NOT (mode IN ('word', 'sentence') AND query = 'set up')",
    "stride_sample": r"""WITH p AS (SELECT line_no, len(regexp_extract_all(lower(en), '[\p{L}\p{Nd}'']+')) AS en_tokens, len(regexp_extract_all(lower(vi), '[\p{L}\p{Nd}]+')) AS vi_tokens FROM parallel_pairs), m AS (SELECT greatest(1, max(line_no) // 1000) AS s FROM p)
 SELECT line_no, en_tokens::INT AS en_tokens, vi_tokens::INT AS vi_tokens FROM p, m WHERE (line_no - 1) % s = 0 AND en_tokens BETWEEN 1 AND 20 AND vi_tokens BETWEEN 1 AND 20 ORDER BY line_no LIMIT 1000""",
    "em_iteration_1": f"{_em(1)} SELECT e, f, round(t, 6) AS t FROM t1",
    "em_model1": f"{_em(4, whole=True)} SELECT e, f, round(t, 6) AS t FROM t4 WHERE round(t, 6) >= 0.005",
    "lexicon_topk": f"{_em(4, whole=True)}, {_TOP} SELECT e, string_agg(printf('%s(%.3f)', f, q / 65535.0::DOUBLE), ' ' ORDER BY rank) AS translations FROM top GROUP BY 1",
    "lexicon_probability": f"{_em(4)}, {_TOP}, {_GLOSS}, ask AS (SELECT DISTINCT headword_norm AS en, unnest({_tokens('gloss')}) AS vi FROM gl JOIN entries USING (entry_id)) SELECT en, vi, round(coalesce(q / 65535.0::DOUBLE, 0), 6) AS p FROM ask LEFT JOIN top ON top.e = lower(en) AND top.f = vi",
    "lexicon_score_gloss": f"""{_em(4)}, {_TOP}, s AS (SELECT entry_id, headword_norm, unnest(range(0, len(senses))) AS sense_no, unnest(senses) AS s FROM entries),
 g AS (SELECT entry_id, headword_norm, sense_no, unnest(range(0, len(s.glosses))) AS gloss_no, unnest(s.glosses) AS gloss FROM s), al AS (SELECT *, {_alternatives('gloss')} AS alts FROM g WHERE gloss IS NOT NULL),
 a AS (SELECT entry_id, headword_norm, sense_no, gloss_no, unnest(range(0, len(alts))) AS alt_no, unnest(alts) AS alt FROM al), w AS (SELECT *, {_tokens('alt')} AS ws FROM a), t AS (SELECT *, len(ws) AS n, unnest(ws) AS f2 FROM w),
 m AS (SELECT entry_id, sense_no, gloss_no, alt_no, sum(q / 65535.0::DOUBLE) / sqrt(any_value(n)) AS score FROM t JOIN top ON top.e = lower(headword_norm) AND top.f = f2 GROUP BY 1, 2, 3, 4)
 SELECT entry_id, sense_no::INT AS sense_no, gloss_no::INT AS gloss_no, round(max(score), 6) AS score FROM m GROUP BY 1, 2, 3""",
    "english_vocabulary": f"WITH {_ENGLISH} SELECT word, row_number() OVER (ORDER BY word) AS id FROM envoc",
    "vietnamese_vocabulary": f"WITH {_VIETNAMESE} SELECT word, row_number() OVER (ORDER BY word) AS id FROM vivoc",
    "em_vocabulary": f"{_em(2, True)} SELECT e, f, round(t, 6) AS t FROM t2 WHERE f <> ''",
    "accent_forms": f"WITH {_DOCS}, d AS (SELECT DISTINCT term FROM tok) SELECT {_fold('term')} AS folded, string_agg(term, ' ' ORDER BY term) AS forms FROM d GROUP BY 1",
    "source_totals": "WITH f AS (SELECT source_id, count(*) AS found FROM entries GROUP BY 1) SELECT coalesce(c.id, f.source_id) AS source_id, c.entries AS declared, coalesce(found, 0) AS found FROM dict_sources c FULL JOIN f ON c.id = f.source_id",
    "source_set_enabled": "SELECT source_id, count(*) AS n FROM entries e LEFT JOIN dict_sources c ON c.id = e.source_id WHERE source_id <> 2 AND coalesce(c.enabled = 1, true) GROUP BY 1",
    "source_lookup": f"WITH {_KEYS}, {_LOOKUP} SELECT query_id, key, entry_id, {_CATALOG} AS source_priority FROM asked JOIN keys USING (key) JOIN entries e USING (entry_id) LEFT JOIN dict_sources c ON c.id = e.source_id WHERE coalesce(c.enabled = 1, true)",
    "entry_ordinals": "SELECT row_number() OVER (ORDER BY headword_norm, source_id, source_line, entry_id) - 1 AS ordinal, entry_id FROM entries",
    "idiom_focus": f"""WITH {_KEYS}, asked AS (SELECT DISTINCT query, {_norm('query')} AS key FROM lookup_history WHERE contains(query, ' ')), h AS (SELECT query, key, entry_id FROM asked JOIN keys USING (key) WHERE contains(key, ' ')),
 m AS (SELECT h.query, ik.entry_id FROM h JOIN ik USING (entry_id) WHERE ik.k = h.key OR ik.k = 'to ' || h.key OR 'to ' || ik.k = h.key) SELECT query, count(*) AS idioms, count(DISTINCT entry_id) AS entries FROM m GROUP BY 1""",
    "gloss_functions": rf"""WITH {_GLOSS}, d AS (SELECT DISTINCT * FROM gl WHERE gloss IS NOT NULL) SELECT entry_id, gloss, coalesce({_alternatives('gloss')}[1], {_collapse('gloss')}) AS short, (NOT regexp_matches(gloss, '[^ \t\n\x0b\f\r]') OR contains(gloss, '<')) AS junk,
 {_fold(r"lower(regexp_replace(gloss, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'))")} AS plain FROM d""",
    "usable_glosses": rf"WITH {_GLOSS} SELECT {_collapse('gloss')} AS gloss, count(*) AS n FROM gl WHERE regexp_matches(gloss, '[^ \t\n\x0b\f\r]') AND NOT contains(gloss, '<') GROUP BY 1",
    "history_described": rf"""WITH {_LOG}, p AS (SELECT *, regexp_replace(trim(query), '[ \t\n\x0b\f\r]+', ' ', 'g') AS line, to_timestamp(epoch_second) AT TIME ZONE 'UTC' AS ts FROM lg)
 SELECT epoch_second, mode, query, CASE WHEN year(ts) = 2024 THEN strftime(ts, '%d/%m %H:%M') ELSE strftime(ts, '%d/%m/%Y %H:%M') END AS time, CASE WHEN length(line) > 110 THEN substr(line, 1, 110) || '…' ELSE line END AS preview FROM p""",
    "history_matching": rf"""WITH {_LOG} SELECT mode, query, len(regexp_split_to_array(trim(query), '[ \t\n\x0b\f\r]+')) >= 4 AS sentence, regexp_replace(query, '[ \t\n\x0b\f\r]*[\r\n]+[ \t\n\x0b\f\r]*', ' ', 'g') AS pasted, count(*) AS n FROM lg WHERE contains(lower(query), 'set') GROUP BY 1, 2, 3, 4""",
    "history_compact": f"""WITH {_LOG}, d AS (SELECT DISTINCT * FROM lg), b AS (SELECT *, lag((mode, query)) OVER (ORDER BY epoch_second, mode, query) AS b FROM d), k AS (SELECT epoch_second, mode, query FROM b WHERE b IS NULL OR b <> (mode, query)),
 n AS (SELECT count(*) AS n FROM k), r AS (SELECT *, row_number() OVER (ORDER BY epoch_second DESC, mode, query) AS r FROM k) SELECT epoch_second, mode, query FROM r, n WHERE n <= 2000 OR r <= 1000""",
    "tsv_scan": rf"""WITH l AS (SELECT source_id, line_no, regexp_replace(raw_line, '^\x{{FEFF}}', '') AS t FROM tsv_lines WHERE regexp_matches(raw_line, '[^ \t\n\x0b\f\r]')), f AS (SELECT *, string_split(t, chr(9)) AS f FROM l WHERE NOT starts_with(t, '#')),
 v AS (SELECT source_id, line_no AS source_line, list_transform(f, lambda x: trim(regexp_replace(x, '[\r\n]+$', ''))) AS f FROM f) SELECT source_id, source_line, f[1] AS headword, f[2] AS gloss, CASE WHEN f[3] <> '' THEN f[3] END AS pos FROM v WHERE f[1] <> '' AND f[2] <> ''""",
    "reverse_search": f"""WITH e AS (SELECT entry_id, headword, headword_norm, flatten(list_transform(coalesce(senses, []), lambda s: coalesce(s.glosses, []))) AS gl, list_transform(coalesce(senses, []), lambda s: coalesce(s.glosses[1], '')) AS firsts, flatten(list_transform(coalesce(idioms, []), lambda s: coalesce(s.glosses, []))) AS ig FROM entries),
 docs AS (SELECT entry_id AS doc_id, {_tokens("coalesce(array_to_string(list_concat(gl, ig), chr(10)), '')")} AS tokens FROM e), tok AS (SELECT doc_id, unnest(tokens) AS term FROM docs),
 q AS (SELECT entry_id AS query_id, lower(list_filter(gl, lambda g: g IS NOT NULL)[1]) AS q FROM e WHERE entry_id % 100 = 0), ql AS (SELECT query_id, q, list_distinct({_tokens('q')}) AS ts FROM q WHERE q IS NOT NULL), qt AS (SELECT query_id, len(ts) AS asked, unnest(ts) AS term FROM ql),
 st AS (SELECT count(*) AS n, greatest(1.0, avg(len(tokens))) AS a FROM docs), dl AS (SELECT doc_id, len(tokens) AS l FROM docs),
 tf AS (SELECT term, doc_id, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 h AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.8::DOUBLE + 0.2::DOUBLE * l / a))) AS score, count(*) AS matched, max(asked) AS asked FROM tf JOIN df USING (term) JOIN dl USING (doc_id) JOIN qt USING (term), st GROUP BY 1, 2),
 b AS (SELECT h.query_id, h.doc_id, headword, h.score * pow(matched / asked::DOUBLE, 2.0) * (CASE WHEN len(list_filter(gl, lambda g: list_contains({_alternatives("lower(coalesce(g, ''))")}, q))) > 0 THEN 3.0::DOUBLE ELSE 1.0 END)
  * (CASE WHEN len(list_filter(firsts, lambda g: contains(lower(g), q))) > 0 THEN 1.8::DOUBLE ELSE 1.0 END) * (CASE WHEN headword_norm <> '' AND NOT contains(headword_norm, ' ') THEN 1.4::DOUBLE ELSE 1.0 END) * (CASE WHEN length(headword_norm) <= 6 THEN 1.2::DOUBLE ELSE 1.0 END) AS score
  FROM h JOIN e ON e.entry_id = h.doc_id JOIN ql USING (query_id)) {_top('SELECT query_id, doc_id, headword, round(score, 6) AS score FROM b', 10, 'doc_id')}""",
    "tokenize_lossless": "SELECT doc_id, text FROM documents WHERE text IS NOT NULL",
}
