"""SQL of those queries that SQL can express."""

# Letters that look like one Latin letter, as the operator takes them from ICU.
LOOKALIKES = "ɑɡɣɩɪɯʋʏͿΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγινορσυϒϜϱϲϳϹϺЅІЈАВЕКМНОРСТУХЬагеорсухѕіјѡѴѵҮүһҽӀӏԁԌԛԜԝՍՏՕագզհոռսցքօᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴᴄᴏᴑᴜᴠᴡᴢᴦⲅⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬⳐꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
_SPECIAL_SPACES = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
_INVISIBLE = r"\x{AD}\x{34F}\x{180E}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}"
_LATIN = r"A-Za-z\x{AA}\x{BA}\x{C0}-\x{24F}\x{1E00}-\x{1EFF}"

SQL = {
    "p4_found": rf"""
WITH r AS (
  SELECT 'run' AS item_kind, paragraph_id AS item_id, CAST(k - 1 AS INTEGER) AS run_no, t AS text FROM (
    SELECT paragraph_id, unnest(list_transform(runs, lambda r: r.text)) AS t, generate_subscripts(runs, 1) AS k FROM paragraphs)
  UNION ALL SELECT 'term', CAST(line_no AS VARCHAR), 0, term FROM glossary),
w AS (SELECT item_kind, item_id, run_no, text, unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}\p{{So}}\p{{Cf}}]+|[{_SPECIAL_SPACES}]+')) AS w FROM r WHERE regexp_matches(text, '[^\x00-\x7F]'))
SELECT DISTINCT item_kind, item_id, run_no FROM w WHERE regexp_matches(w, '[{_SPECIAL_SPACES}{_INVISIBLE}\x{{FF10}}-\x{{FF19}}\x{{FF21}}-\x{{FF3A}}\x{{FF41}}-\x{{FF5A}}\x{{FB00}}-\x{{FB06}}]')
  OR (regexp_matches(w, '(^|[^\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{FE0F}}\x{{200C}}\x{{200D}}])[\x{{200C}}\x{{200D}}]') AND NOT regexp_matches(w, '[\x{{600}}-\x{{8FF}}\x{{900}}-\x{{DFF}}\x{{E00}}-\x{{109F}}]'))
  OR nfc_normalize(w) <> w
  OR (regexp_matches(w, '[{LOOKALIKES}]') AND (regexp_matches(w, '[{_LATIN}]') OR NOT regexp_matches(regexp_replace(w, '[{LOOKALIKES}]', '', 'g'), '\p{{L}}')))
""",
    "p1_found": """
SELECT 'chunk' AS item_kind, chapter_id || '/' || chunk_id AS item_id FROM chunks
WHERE ceil(length(text) / 4.0) > (SELECT max(max_tokens) FROM split_limits WHERE item_kind = 'chunk')
UNION
SELECT 'paragraph', paragraph_id FROM paragraphs
WHERE ceil(length(array_to_string(list_transform(runs, lambda r: r.text), '')) / 4.0)
  > (SELECT max(max_tokens) FROM split_limits WHERE item_kind = 'paragraph')
""",
}
