"""ANSI SQL, as DuckDB runs it, of the queries in foliant.plans.core. Word lists are fixed values and come from where they stand."""

from foliant.functions import text as T
from foliant.operators import qa

_P = """p AS (SELECT DISTINCT doc_id, pos, paragraph_id, idref, heading_level, all_bold,
  coalesce(text, array_to_string(list_transform(runs, lambda r: coalesce(r.text, '')), ''), '') AS text FROM paragraphs)"""

_SPACE = r"[\s\v\x{85}\p{Z}]+"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def _norm(c: str) -> str:
    return f"lower({_strip(f"regexp_replace({c}, '{_SPACE}', ' ', 'g')")})"


_HEADINGS = f"""{_P},
m AS (SELECT *, sum(CASE WHEN heading_level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos RANGE UNBOUNDED PRECEDING) AS g FROM p),
h AS (SELECT doc_id, g, arg_max(text, pos) AS title FROM m WHERE heading_level IS NOT NULL GROUP BY doc_id, g),
b AS (SELECT doc_id, g, count(*) AS n FROM m WHERE heading_level IS NULL GROUP BY doc_id, g),
c AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS chapter_no FROM b),
ch AS (SELECT c.doc_id, CAST(c.chapter_no AS INTEGER) AS chapter_no, coalesce(h.title, c.doc_id) AS title, m.pos, m.paragraph_id, m.text
  FROM c JOIN m ON m.doc_id = c.doc_id AND m.g = c.g AND m.heading_level IS NULL LEFT JOIN h ON h.doc_id = c.doc_id AND h.g = c.g)"""

_STATE = """s AS (SELECT chapter_id, chunk_id,
  arg_max({'status': status, 'qa_passed': qa_passed, 'flagged': flagged, 'saved_at': saved_at},
    {'a': coalesce(saved_at, TIMESTAMP '0001-01-01'), 'b': CASE status WHEN 'completed' THEN 2 WHEN 'in_progress' THEN 1 ELSE 0 END,
     'c': coalesce(qa_passed, false), 'd': coalesce(flagged, false)}) AS x,
  bool_or(coalesce(flagged, false)) AS ever_flagged, count(*) AS n_rows FROM progress GROUP BY chapter_id, chunk_id)"""

_STATUS = f"""{_STATE},
t AS (SELECT chapter_id, count(DISTINCT chunk_id) AS total FROM chunks GROUP BY chapter_id),
a AS (SELECT chapter_id, count(*) FILTER (x.qa_passed) AS done, count(*) FILTER (ever_flagged) AS flagged, count(*) FILTER (x.status <> 'not_started') AS begun FROM s GROUP BY chapter_id),
st AS (SELECT chapter_id, total, coalesce(done, 0) AS done, coalesce(flagged, 0) AS flagged,
  CASE WHEN coalesce(done, 0) >= total THEN 'completed' WHEN coalesce(begun, 0) > 0 THEN 'in_progress' ELSE 'not_started' END AS status,
  CAST(round_even(100 * coalesce(done, 0) / total, 0) AS INTEGER) AS percent FROM t LEFT JOIN a USING (chapter_id))"""

_STATS = """x AS (SELECT DISTINCT chapter_id, chunk_id, attempts, qa_passed, flagged, cache_hit, coalesce(len(issues), 0) AS n FROM processed_chunks),
cs AS (SELECT chapter_id, count(*) AS chunks, count(*) FILTER (qa_passed) AS completed, count(*) FILTER (flagged) AS flagged, count(*) FILTER (cache_hit) AS cache_hits,
  CAST(sum(CASE WHEN NOT coalesce(cache_hit, false) THEN coalesce(attempts, 0) ELSE 0 END) AS BIGINT) AS attempts,
  CAST(sum(CASE WHEN NOT coalesce(cache_hit, false) THEN greatest(coalesce(attempts, 0) - 1, 0) ELSE 0 END) AS BIGINT) AS retries,
  CAST(sum(n) AS BIGINT) AS issues FROM x GROUP BY ROLLUP (chapter_id))"""

_PAIRS = """pr AS (SELECT DISTINCT c.chapter_id, c.chunk_id, c.text AS source, p.translation FROM chunks c JOIN processed_chunks p USING (chapter_id, chunk_id))"""

_TITLES = "|".join(T.HONORIFIC_TITLES)
_TAILS = "|".join(T.HONORIFIC_SUFFIXES)


def _core(c: str) -> str:
    """Words joined by blanks; titles and tails go while another word is left."""
    words = f"array_to_string(regexp_extract_all(lower({c}), '[a-z0-9]+'), ' ')"
    tails = f"regexp_replace({words}, '( ({_TAILS}))+$', '')"
    return f"regexp_replace({tails}, '^(({_TITLES}) )+', '')"


def _display(c: str) -> str:
    t = f"regexp_replace({_strip(c)}, '^(?:(?:{_TITLES})\\.?\\s+)+(\\S)', '\\1', 'i')"
    return _strip(f"regexp_replace({t}, '(\\S)(?:(?:-|\\s)(?:{_TAILS}))+$', '\\1', 'i')")


_MENTIONS = f"""nm AS (SELECT DISTINCT mention_id, text, CASE WHEN lower({_strip('entity_type')}) IN ('character','place','organization','item','skill','race','title','proper_noun')
  THEN lower({_strip('entity_type')}) ELSE 'proper_noun' END AS entity_type,
  CASE WHEN isnan(coalesce(confidence, 0.0)) THEN 0.0 ELSE least(greatest(coalesce(confidence, 0.0), 0.0), 1.0) END AS confidence, reason, source_paragraph_id, ord
  FROM mentions WHERE {_strip('text')} <> '')"""

_INDEX = f"""ix AS (SELECT name_key, min(entity_id) AS entity_id FROM (SELECT entity_id, {_norm('name')} AS name_key FROM (
  SELECT entity_id, canonical_name AS name FROM entities UNION ALL SELECT entity_id, unnest(aliases) FROM entities)) WHERE name_key <> '' GROUP BY name_key)"""

_PRUNED = f"""v AS (SELECT DISTINCT mention_id AS ord, {_strip('text')} AS name, coalesce(entity_type, 'lainnya') AS kind FROM mentions),
w AS (SELECT *, {_core('name')} AS core, len(regexp_extract_all(lower(name), '[a-z0-9]+')) AS n FROM v),
pn AS (SELECT core, {_display('best.name')} AS name, best.kind AS kind, ord FROM (
  SELECT core, arg_min({{'name': name, 'kind': kind}}, {{'a': n - len(string_split(core, ' ')), 'b': n, 'c': length(name), 'd': ord, 'e': name}}) AS best, min(ord) AS ord FROM w WHERE core <> '' GROUP BY core))"""

_WORDY = "[\\p{L}\\p{N}\\p{M}_]"
_NOT_WORDY = "[^\\p{L}\\p{N}\\p{M}_]"


def _has(text: str, term: str) -> str:
    return f"regexp_matches({text}, '(^|{_NOT_WORDY})' || regexp_escape({term}) || '($|{_NOT_WORDY})')"


_EVIDENCE = f"""er AS (SELECT entity_id, canonical_name, unnest(research) AS r, generate_subscripts(research, 1) - 1 AS n FROM entities),
ef AS (SELECT *, lower(coalesce(r.title, '') || ' ' || coalesce(r.snippet, '')) AS full_text, lower({_strip('canonical_name')}) AS k FROM er),
ew AS (SELECT *, list_filter(regexp_extract_all(k, '[a-zA-Z0-9]+'), lambda w: length(w) > 2) AS w FROM ef),
ev AS (SELECT entity_id, CAST(n AS INTEGER) AS n, r.snippet AS snippet, CAST(round(least(
    CASE WHEN {_has('full_text', 'k')} THEN 0.7 WHEN len(w) > 0 AND len(list_filter(w, lambda x: NOT {_has('full_text', 'x')})) = 0 THEN 0.5 ELSE 0 END
    + CASE WHEN regexp_matches(coalesce(r.url, ''), '^(?i:https?)://[^/?#\\s]+') THEN 0.2 ELSE 0 END + CASE WHEN {_strip("coalesce(r.snippet, '')")} <> '' THEN 0.1 ELSE 0 END
    + CASE WHEN {_strip("coalesce(r.source, '')")} <> '' THEN 0.05 ELSE 0 END + CASE WHEN contains(lower(coalesce(r.query, '')), lower(canonical_name)) THEN 0.05 ELSE 0 END, 1.0), 2) AS DOUBLE) AS score FROM ew)"""

_SPINE = rf"""{_P},
q AS (SELECT *, {_strip('text')} AS s FROM p WHERE idref IS NOT NULL),
sp AS (SELECT doc_id, idref, count(*) AS n, count(*) FILTER (s <> '') AS filled, count(*) FILTER (heading_level IS NOT NULL) AS headings,
  count(*) FILTER (regexp_matches(s, '^\s*(chapter|chap\.|prologue|epilogue|appendix|part)\b', 'i')) AS markers,
  count(*) FILTER (s <> '' AND NOT coalesce(all_bold AND heading_level IS NULL, false)) AS plain, sum(CASE WHEN s <> '' THEN length(s) + 1 ELSE 0 END) AS chars,
  min(pos) AS start, arg_min(s, pos) FILTER (heading_level IS NOT NULL AND s <> '') AS heading,
  arg_min(s, pos) FILTER (regexp_matches(s, '^(Chapter|Extra Chapter)\b', 'i')) AS marker, arg_min(s, pos) FILTER (s <> '') AS opening FROM q GROUP BY doc_id, idref),
k AS (SELECT *, headings = 0 AND markers = 0 AND n <= 8 AND filled > 0 AND plain = 0 AND chars - 1 <= 500 AS front, headings > 0 OR markers > 0 AS sure FROM sp)"""

_ENGLISH = ", ".join(f"'{w}'" for w in qa.ENGLISH_WORDS)


def _english(c: str) -> str:
    """A sentence with four words, two of them English; short quoted spans without punctuation and URLs left out."""
    no_url = f"regexp_replace({c}, 'https?://\\S+|www\\.\\S+', ' ', 'g')"
    span = '“[^”\\n]*”|"[^"\\n]*"'
    parts = f"string_split(regexp_replace({no_url}, '({span})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    inner = "x[2:-2]"
    words = f"len(list_filter(regexp_split_to_array({inner}, '\\s+'), lambda w: w <> ''))"
    drop = f"regexp_full_match(x, '{span}') AND {words} <= 8 AND NOT regexp_matches({inner}, '[.,!?;:]')"
    text = f"array_to_string(list_transform({parts}, lambda x: CASE WHEN {drop} THEN ' ' ELSE x END), '')"
    found = "regexp_extract_all(lower(s), '[a-z'']+')"
    ok = f"len({found}) >= 4 AND len(list_filter({found}, lambda w: w IN ({_ENGLISH}))) >= 2"
    return f"len(list_filter(regexp_split_to_array({text}, '[.!?]+'), lambda s: {ok})) > 0"


def _matter(t: str) -> str:
    return f"""f AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(doc_id), '[^a-z0-9]', '', 'g') AS b FROM {t}),
y AS (SELECT doc_id, chapter_no, title, (a <> '' AND b <> '' AND starts_with(a, b) AND length(a) - length(b) < 10)
  OR regexp_matches(title, '\\b(cover|sampul|title page|copyright|colou?r gallery|illustrations?|afterword|table of contents|contents|credits|map|about the author|translator''?s note|author''?s note|promo|bonus)\\b', 'i') AS m FROM f)"""


def _blank(c: str) -> str:
    return f"{_strip(c)} = ''"


SQL = {
    "q01_paragraph_tokens": """
SELECT doc_id, CAST(k - 1 AS INTEGER) AS pos, CAST(length(line) AS INTEGER) AS chars,
  CAST(CASE WHEN length(line) = 0 THEN 0 ELSE greatest(1, ceil(length(line) / 4.0)) END AS INTEGER) AS tokens
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL)""",
    "q02_greedy_chunks": f"""
WITH RECURSIVE {_HEADINGS},
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chapter_no ORDER BY pos, paragraph_id) AS i FROM ch),
f AS (
  SELECT doc_id, chapter_no, i, text, 0 AS chunk_no, length(text) AS size, text = '' AS shut FROM n WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.chapter_no, n.i, n.text,
    CASE WHEN f.shut OR n.text = '' OR ceil((f.size + 1 + length(n.text)) / 4.0) > 1200 THEN f.chunk_no + 1 ELSE f.chunk_no END,
    CASE WHEN f.shut OR n.text = '' OR ceil((f.size + 1 + length(n.text)) / 4.0) > 1200 THEN length(n.text) ELSE f.size + 1 + length(n.text) END,
    n.text = ''
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.chapter_no = f.chapter_no AND n.i = f.i + 1)
SELECT doc_id, chapter_no, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(count(*) AS INTEGER) AS n_paragraphs,
  CAST(ceil(max(size) / 4.0) AS INTEGER) AS estimated_tokens, md5(string_agg(text, chr(10) ORDER BY i)) AS text_md5
FROM f GROUP BY doc_id, chapter_no, chunk_no""",
    "q03_chunk_totals": "SELECT chapter_id, count(DISTINCT chunk_id) AS total FROM chunks GROUP BY chapter_id",
    "q04_keep_source": rf"""
SELECT chapter_id, chunk_id, regexp_matches({_strip('text')}, '^(https?://|www\.)\S+$', 'i') AS is_url
FROM (SELECT DISTINCT chapter_id, chunk_id, text FROM chunks WHERE text IS NOT NULL)
WHERE NOT regexp_matches(text, '\p{{L}}') OR regexp_matches({_strip('text')}, '^(https?://|www\.)\S+$', 'i')""",
    "q05_chapter_status": f"WITH {_STATUS} SELECT * FROM st",
    "q05_status_summary": f"""
WITH {_STATUS}, to_ AS (SELECT chapter_id, max(saved_at) AS touched FROM progress GROUP BY chapter_id)
SELECT count(*) AS chapters, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'in_progress') AS in_progress,
  count(*) FILTER (status = 'not_started') AS not_started, CAST(sum(total) AS BIGINT) AS chunks, CAST(sum(done) AS BIGINT) AS done, CAST(sum(flagged) AS BIGINT) AS flagged,
  CAST(round_even(100 * sum(done) / sum(total), 0) AS INTEGER) AS percent, arg_min(chapter_id, {{'a': -epoch_us(coalesce(touched, TIMESTAMP '1970-01-01')), 'b': chapter_id}}) FILTER (status = 'in_progress' AND total > 0) AS active FROM st LEFT JOIN to_ USING (chapter_id)""",
    "q06_chapter_stats": f"WITH {_STATS} SELECT * FROM cs",
    "q06_run_summary": f"""
WITH {_STATS} SELECT chunks, completed, flagged, cache_hits, attempts, retries, issues, CAST(round_even(100 * completed / chunks, 0) AS INTEGER) AS percent FROM cs WHERE chapter_id IS NULL""",
    "q07_completion": "SELECT chapter_id, bool_and(coalesce(qa_passed, false)) AS complete FROM processed_chunks GROUP BY chapter_id",
    "q08_latest_state": f"WITH {_STATE} SELECT chapter_id, chunk_id, x.status AS status, x.qa_passed AS qa_passed, x.flagged AS flagged, x.saved_at AS saved_at, ever_flagged, n_rows FROM s",
    "q09_usage": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "q10_heading_chapters": f"WITH {_HEADINGS} SELECT doc_id, chapter_no, any_value(title) AS title, count(*) AS n_paragraphs, min(pos) AS start FROM ch GROUP BY doc_id, chapter_no",
    "q11_glossary_sections": "SELECT line_no, last_value(section IGNORE NULLS) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS filled, term FROM glossary",
    "q12_first_wins": f"SELECT {_norm('text')} AS name_key, min(mention_id) AS mention_id, arg_min(text, mention_id) AS text FROM mentions GROUP BY 1",
    "q12_first_wins_in_paragraph": f"SELECT {_norm('text')} AS name_key, source_paragraph_id, min(mention_id) AS mention_id FROM mentions GROUP BY 1, 2",
    "q13_prune_variants": f"WITH {_PRUNED} SELECT * FROM pn",
    "q14_not_contained": f"""
WITH {_PRUNED} SELECT core FROM pn a WHERE NOT EXISTS (SELECT 1 FROM pn b WHERE a.core <> b.core AND contains(' ' || b.core || ' ', ' ' || a.core || ' '))""",
    "q15_valid_mentions": f"WITH {_MENTIONS} SELECT mention_id, text, entity_type, confidence, source_paragraph_id FROM nm WHERE source_paragraph_id IN (SELECT paragraph_id FROM paragraphs)",
    "q16_completeness": """
WITH e AS (SELECT DISTINCT unnest(paragraph_ids) AS paragraph_id FROM chunks), a AS (SELECT DISTINCT paragraph_id FROM assembled_paragraphs)
SELECT paragraph_id, 'missing' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT paragraph_id, 'unexpected' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)""",
    "q16_chunk_paragraphs": """
WITH r AS (SELECT DISTINCT c.chapter_id, c.chunk_id, c.paragraph_ids AS i, CASE WHEN len(c.paragraph_ids) = 1 THEN [p.translation] ELSE coalesce(p.paragraph_translations, []) END AS t
  FROM chunks c JOIN processed_chunks p USING (chapter_id, chunk_id)),
x AS (SELECT chapter_id, chunk_id, i, t, unnest(range(1, greatest(len(i), len(t)) + 1)) AS k FROM r)
SELECT chapter_id, chunk_id, count(*) AS n, count(*) FILTER (i[k] IS NULL) AS unexpected, count(*) FILTER (t[k] IS NULL) AS missing FROM x GROUP BY chapter_id, chunk_id""",
    "q17_translated_or_original": """
WITH t AS (SELECT paragraph_id, max(translated_text) AS t FROM assembled_paragraphs WHERE trim(coalesce(translated_text, ''), ' ') <> '' GROUP BY paragraph_id)
SELECT paragraph_id, md5(coalesce(t, text)) AS text_md5, t IS NOT NULL AS translated FROM (SELECT DISTINCT paragraph_id, coalesce(text, '') AS text FROM paragraphs) LEFT JOIN t USING (paragraph_id)""",
    "q18_glossary_aliases": f"""
WITH r AS (SELECT line_no, {_strip('term')} AS term, {_strip('meaning')} AS meaning, coalesce(is_alias, false) AS is_alias FROM glossary
  WHERE coalesce(active, true) AND {_strip('term')} <> '' AND {_strip('meaning')} <> ''),
t AS (SELECT lower(term) AS k, arg_max(meaning, line_no) AS m FROM r WHERE NOT is_alias GROUP BY 1)
SELECT term, meaning, line_no FROM r WHERE NOT is_alias UNION ALL SELECT term, m, line_no FROM r JOIN t ON lower(meaning) = k WHERE is_alias""",
    "q18_name_index": f"WITH {_INDEX} SELECT * FROM ix",
    "q19_qa_issues": f"""
WITH {_PAIRS}, z AS (SELECT chapter_id, chunk_id, coalesce(source, '') AS s, coalesce(translation, '') AS t FROM pr),
l AS (SELECT chapter_id, chunk_id, s, t, string_split(s, chr(10)) AS sl, string_split(t, chr(10)) AS tl FROM z),
x AS (SELECT *, unnest(range(1, len(tl) + 1)) AS k FROM l WHERE t <> ''),
r AS (
  SELECT chapter_id, chunk_id, 'translation_not_empty' AS rule, 1 AS n FROM l WHERE {_blank('t')}
  UNION ALL SELECT chapter_id, chunk_id, 'paragraph_count', 1 FROM l WHERE CASE WHEN s = '' THEN 0 ELSE len(sl) END <> CASE WHEN t = '' THEN 0 ELSE len(tl) END
  UNION ALL SELECT chapter_id, chunk_id, 'empty_paragraph', 1 FROM x WHERE {_blank('tl[k]')} AND NOT (k <= len(sl) AND {_blank("coalesce(sl[k], 'x')")})
  UNION ALL SELECT chapter_id, chunk_id, 'unexpected_model_text', 1 FROM l WHERE regexp_matches({_strip('t')}, '^(Translation:|Here is the translation:|Here is your translation:|Translator''s note:|Note:)', 'i')
  UNION ALL SELECT chapter_id, chunk_id, 'untranslated_english', 1 FROM x WHERE {_english('tl[k]')}
  UNION ALL SELECT chapter_id, chunk_id, 'source_echo', 1 FROM x WHERE contains(tl[k], '->') OR contains(tl[k], '→'))
SELECT chapter_id, chunk_id, rule, count(*) AS n FROM r GROUP BY ALL""",
    "q20_untranslated_english": f"SELECT DISTINCT paragraph_id FROM (SELECT DISTINCT paragraph_id, translated_text FROM assembled_paragraphs WHERE translated_text IS NOT NULL) WHERE {_english('translated_text')}",
    "q22_preserved_entities": f"""
WITH {_MENTIONS}, {_P}, t AS (SELECT DISTINCT paragraph_id, translated_text FROM assembled_paragraphs),
n AS (SELECT DISTINCT source_paragraph_id AS paragraph_id, text AS name FROM nm)
SELECT paragraph_id, 'missing ' || name AS message FROM n JOIN (SELECT paragraph_id, text FROM p) USING (paragraph_id) JOIN t USING (paragraph_id)
WHERE contains({_norm('text')}, {_norm('name')}) AND NOT contains(lower(coalesce(translated_text, '')), lower({_strip('name')}))""",
    "q24_search_queries": """
SELECT entity_id, '"' || canonical_name || '"' || coalesce(' ' || CASE entity_type WHEN 'character' THEN 'character' WHEN 'place' THEN 'location' WHEN 'organization' THEN 'organization'
  WHEN 'item' THEN 'item' WHEN 'skill' THEN 'skill' WHEN 'race' THEN 'race' WHEN 'title' THEN 'title' END, '') || ' "The Novel" "An Author"' AS query FROM entities""",
    "q27_spine_classes": f"""
WITH {_SPINE} SELECT doc_id, idref, CASE WHEN front THEN 'front_matter' WHEN sure OR n > 8 THEN 'chapter' ELSE 'ambiguous' END AS classification,
  CAST(CASE WHEN front OR sure THEN 0.95 WHEN n > 8 THEN 0.85 ELSE 0.5 END AS DOUBLE) AS confidence FROM k""",
    "q28_spine_chapters": f"""
WITH {_SPINE}, y AS (SELECT *, coalesce(heading, marker, CASE WHEN length(opening) > 60 THEN rtrim(opening[1:60]) || '…' ELSE opening END, 'Untitled Chapter') AS title FROM k WHERE NOT front)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, idref) AS INTEGER) AS chapter_no, idref, title, CAST(n - CASE WHEN heading IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_paragraphs
FROM y WHERE {_norm('title')} NOT IN ('contents', 'table of contents', 'toc', 'daftar isi', 'isi', 'daftar kandungan') AND NOT regexp_matches(lower(idref), 'toc|contents|tableofcontents|daftarisi')""",
    "q29_story_flags": f"""
WITH {_HEADINGS}, t AS (SELECT doc_id, chapter_no, any_value(title) AS title FROM ch GROUP BY doc_id, chapter_no),
{_matter('t')}
SELECT doc_id, chapter_no, title, m AND NOT bool_and(m) OVER (PARTITION BY doc_id) AS is_matter FROM y""",
    "q30_distributed_runs": """
WITH r AS (SELECT DISTINCT paragraph_id, list_transform(runs, lambda r: length(coalesce(r.text, ''))) AS l FROM paragraphs WHERE len(runs) > 0),
t AS (SELECT paragraph_id, max(translated_text) AS t FROM assembled_paragraphs WHERE translated_text IS NOT NULL GROUP BY paragraph_id),
x AS (SELECT paragraph_id, l, t, CAST(list_sum(l) AS BIGINT) AS total, unnest(range(1, len(l) + 1)) AS k FROM r JOIN t USING (paragraph_id)),
b AS (SELECT paragraph_id, k, t, total, CASE WHEN k = 1 THEN 0 ELSE CAST(round_even(length(t) * list_sum(l[1:k - 1]) / nullif(total, 0), 0) AS BIGINT) END AS a,
  CASE WHEN k = len(l) THEN length(t) ELSE CAST(round_even(length(t) * list_sum(l[1:k]) / nullif(total, 0), 0) AS BIGINT) END AS z FROM x),
p AS (SELECT paragraph_id, k, CASE WHEN total = 0 THEN CASE WHEN k = 1 THEN t ELSE '' END ELSE substring(t, a + 1, greatest(z - a, 0)) END AS part FROM b)
SELECT paragraph_id, CAST(k - 1 AS INTEGER) AS run_no, CAST(length(part) AS INTEGER) AS chars, md5(part) AS part_md5 FROM p""",
    "q31_chapter_bounds": f"""
WITH {_P}, s AS (SELECT DISTINCT doc_id, pos AS start FROM p WHERE heading_level IS NOT NULL), t AS (SELECT doc_id, max(pos) + 1 AS total FROM p GROUP BY doc_id),
r AS (SELECT doc_id, CAST(row_number() OVER w AS INTEGER) AS chapter_no, start, coalesce(lead(start) OVER w, total) AS stop FROM s JOIN t USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY start))
SELECT * FROM r UNION ALL SELECT doc_id, 0, 0, start FROM r WHERE chapter_no = 1 AND start > 0""",
    "q32_sessions": """
SELECT user_id, CAST(s AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_event FROM (
  SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id RANGE UNBOUNDED PRECEDING) AS s FROM events) WHERE s > 0 GROUP BY user_id, s""",
    "q33_cache_probe": """
WITH c AS (SELECT DISTINCT chapter_id, chunk_id, text, array_to_string(paragraph_texts, chr(10)) AS p FROM chunks),
k AS (SELECT chapter_id, chunk_id, sha256(CASE WHEN text IS NULL THEN '~' ELSE length(text) || ':' || text END || chr(31) || CASE WHEN p IS NULL THEN '~' ELSE length(p) || ':' || p END || chr(31) || '5:model') AS key FROM c),
g AS (SELECT DISTINCT k.key FROM k JOIN processed_chunks p USING (chapter_id, chunk_id) WHERE p.qa_passed AND trim(p.translation, ' ') <> '')
SELECT chapter_id, chunk_id, key, key IN (SELECT key FROM g) AS hit FROM k""",
    "q34_name_forms": f"""
SELECT text, {_norm('text')} AS name_key, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS squashed, {_core('text')} AS core, {_display('text')} AS display FROM (SELECT DISTINCT text FROM mentions WHERE text IS NOT NULL)""",
    "q35_ranges": "SELECT * FROM (VALUES ('2,5,7-8', '2,5,7,8'), ('3', '3'), ('2-5', '2,3,4,5'), ('5-2', NULL), ('a', NULL), ('1, 1 ,2-3', '1,2,3'), ('', NULL)) AS t(value, numbers)",
    "q36_repeated_ids": "SELECT paragraph_id, count(*) AS n FROM paragraphs GROUP BY paragraph_id HAVING count(*) > 1",
    "q37_newest_events": """
SELECT user_id, event_id, event_type, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3""",
    "q38_json_fields": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "q40_paths": "SELECT DISTINCT url, 'OEBPS/' || regexp_replace(url, '^https?://', '') AS path FROM (SELECT unnest(list_transform(research, lambda r: r.url)) AS url FROM entities)",
    "q41_output_gate": f"WITH {_STATUS} SELECT *, failed > 0 OR flagged > 0 AS blocked FROM (SELECT count(*) FILTER (status <> 'completed') AS failed, CAST(sum(flagged) AS BIGINT) AS flagged FROM st)",
    "q42_resolved_mentions": f"""
WITH {_MENTIONS}, {_INDEX}, f AS (SELECT {_norm('text')} AS name_key, min(mention_id) AS mention_id, arg_min(text, mention_id) AS text FROM nm GROUP BY 1)
SELECT mention_id, text, ix.entity_id, CASE WHEN ix.entity_id IS NULL THEN 'new' WHEN coalesce(research_failed, false) THEN 'research_failed' ELSE 'known' END AS status
FROM f LEFT JOIN ix USING (name_key) LEFT JOIN entities e ON e.entity_id = ix.entity_id""",
    "q43_merged_chapters": """
WITH d AS (SELECT DISTINCT chapter_id, chunk_id, translation, paragraph_translations, attempts, qa_passed, flagged FROM processed_chunks)
SELECT chapter_id, md5(string_agg(coalesce(translation, ''), chr(10) ORDER BY chunk_id)) AS text_md5, CAST(sum(coalesce(len(paragraph_translations), 0)) AS INTEGER) AS n,
  CAST(sum(coalesce(attempts, 0)) AS BIGINT) AS attempts, bool_and(coalesce(qa_passed, false)) AS qa_passed, bool_or(coalesce(flagged, false)) AS flagged FROM d GROUP BY chapter_id""",
    "q44_glossary_stats": "SELECT count(*) AS total, count(*) FILTER (trim(coalesce(meaning, ''), ' ') = '') AS empty, count(*) FILTER (NOT coalesce(active, true)) AS disabled, count(*) FILTER (coalesce(is_alias, false)) AS aliases FROM glossary",
    "q46_new_terms": f"WITH {_PRUNED} SELECT core, name, kind FROM pn WHERE lower({_strip('name')}) NOT IN (SELECT lower({_strip('term')}) FROM glossary WHERE term IS NOT NULL)",
    "q48_pending_chunks": f"WITH {_STATE} SELECT DISTINCT chapter_id, chunk_id FROM chunks EXCEPT SELECT chapter_id, chunk_id FROM s WHERE x.qa_passed",
}
SQL["q19_qa_passed"] = f"WITH i AS ({SQL['q19_qa_issues']}), {_PAIRS} SELECT (i.chapter_id IS NULL) AS passed, count(*) AS n FROM pr LEFT JOIN (SELECT DISTINCT chapter_id, chunk_id FROM i) i USING (chapter_id, chunk_id) GROUP BY 1"
SQL["q42_resolution_stats"] = f"SELECT status, count(*) AS mentions, count(DISTINCT entity_id) AS entities FROM ({SQL['q42_resolved_mentions']}) GROUP BY status"
SQL["q45_names_by_kind"] = f"WITH {_PRUNED}, d AS (SELECT DISTINCT kind, name FROM pn) SELECT kind, CAST(count(*) AS INTEGER) AS n, arg_min(name, {{'a': lower(name), 'b': name}}) AS first_name FROM d GROUP BY kind"
SQL["q23_evidence"] = f"WITH {_EVIDENCE} SELECT entity_id, n, score, score >= 0.5 AS valid FROM ev"
SQL["q47_term_meanings"] = f"""
WITH {_PRUNED}, {_INDEX}, {_EVIDENCE},
sn AS (SELECT entity_id, least(count(*), 3) AS c FROM ev WHERE score >= 0.5 AND trim(snippet, ' ') <> '' GROUP BY entity_id)
SELECT DISTINCT name, e.translation AS meaning, CAST(CASE WHEN e.translation IS NULL THEN coalesce(c, 0) ELSE 0 END AS INTEGER) AS n_snippets
FROM pn LEFT JOIN ix ON ix.name_key = {_norm('name')} LEFT JOIN entities e ON e.entity_id = ix.entity_id LEFT JOIN sn ON sn.entity_id = ix.entity_id"""
_T = _strip("t")
_BODY = _strip(f"regexp_extract({_T}, '^(Chapter\\s+\\d+\\s*:\\s*)(.+)$', 2, 'is')")
SQL["q39_title_errors"] = f"""
WITH {_P}, x AS (SELECT paragraph_id, p.text AS title, max(translated_text) AS t FROM p JOIN assembled_paragraphs USING (paragraph_id)
  WHERE heading_level IS NOT NULL AND translated_text IS NOT NULL GROUP BY paragraph_id, p.text),
y AS (SELECT *, {_BODY} AS body FROM x)
SELECT paragraph_id, CASE WHEN NOT regexp_matches({_strip('title')}, '^Chapter\\s+\\d+\\s*:\\s*.+$', 'is') THEN NULL
  WHEN NOT regexp_matches({_T}, '^Chapter\\s+\\d+\\s*:\\s*.+$', 'is') THEN 'prefix'
  WHEN regexp_extract(title, '(\\d+)', 1) <> regexp_extract(t, '(\\d+)', 1) THEN 'number'
  WHEN NOT regexp_matches(body, '^.+\\([^(]*\\)$', 's') THEN 'parenthesis'
  WHEN {_strip("regexp_extract(body, '^.+\\(([^(]*)\\)$', 1, 's')")} = '' THEN 'empty'
  WHEN regexp_matches({_strip("regexp_extract(body, '^.+\\(([^(]*)\\)$', 1, 's')")}, '^chapter\\s+\\d+$', 'i') THEN 'label' END AS error,
  CASE WHEN regexp_matches({_strip('title')}, '^chapter\\s+\\d+$', 'i') THEN {_strip('title')} || ' (Bab ' || regexp_extract(title, '(\\d+)', 1) || ')' END AS label FROM y"""
SQL["q25_glossary_replaced"] = f"""
WITH RECURSIVE g AS ({SQL["q18_glossary_aliases"]}),
w AS (SELECT term, arg_min(meaning, line_no) AS meaning, min(line_no) AS line_no FROM g GROUP BY term),
fm AS (SELECT form, arg_min(meaning, {{'a': line_no, 'b': k}}) AS meaning FROM (SELECT term AS form, meaning, line_no, 0 AS k FROM w
  UNION ALL SELECT replace(term, '’', chr(39)), meaning, line_no, 1 FROM w UNION ALL SELECT replace(term, chr(39), '’'), meaning, line_no, 2 FROM w) GROUP BY form),
t AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT paragraph_id, translated_text AS x FROM assembled_paragraphs)),
ps AS (SELECT id, x, CAST(unnest(generate_series(1, length(x))) AS INTEGER) AS pos FROM t WHERE x IS NOT NULL),
m AS (SELECT id, pos, arg_max(form, length(form)) AS form, arg_max(meaning, length(form)) AS meaning FROM (SELECT * FROM ps WHERE NOT regexp_matches(substr(x, pos - 1, CASE WHEN pos > 1 THEN 1 ELSE 0 END), '[A-Za-z]')) ps
  JOIN fm ON substr(x, pos, 1) = substr(form, 1, 1) WHERE substr(x, pos, length(form)) = form AND NOT regexp_matches(substr(x, pos + length(form), 1), '[A-Za-z]') GROUP BY id, pos),
f AS (SELECT id, pos, form, meaning, pos + length(form) AS stop FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM m) WHERE k = 1
  UNION ALL SELECT id, pos, form, meaning, stop FROM (SELECT m.id, m.pos, m.form, m.meaning, m.pos + length(m.form) AS stop, row_number() OVER (PARTITION BY m.id ORDER BY m.pos) AS k FROM f JOIN m ON m.id = f.id AND m.pos >= f.stop) WHERE k = 1),
o AS (SELECT *, lag(stop, 1, 1) OVER (PARTITION BY id ORDER BY pos) AS start FROM f),
r AS (SELECT o.id, string_agg(substr(x, CAST(start AS INTEGER), CAST(o.pos - start AS INTEGER)) || meaning, '' ORDER BY o.pos) AS made, max(stop) AS stop FROM o JOIN t USING (id) GROUP BY o.id)
SELECT paragraph_id, CASE WHEN r.id IS NULL THEN x ELSE made || substr(x, CAST(stop AS INTEGER)) END AS replaced FROM t LEFT JOIN r USING (id)"""
