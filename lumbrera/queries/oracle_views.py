"""Intermediate views of the oracle SQL.

They restate the operators' meaning in another dialect and by another route (tokens and windows
instead of marks and folds), so that agreement says something.
"""

from __future__ import annotations

from lumbrera import config as cfg

WS = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
NOT_WS = r"[^\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
WORD = r"[\p{L}\p{N}_]+"
CLOSERS = "[\"''»”’)\\]]*"


def quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def trim(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{WS}+', ''), '{WS}+$', '')"


def collapse(expr: str) -> str:
    return trim(f"regexp_replace({expr}, '{WS}+', ' ', 'g')")


def wc(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, '{WORD}')) AS INT)"


def excerpt(expr: str, n: int) -> str:
    head = rf"regexp_extract({expr}, '^(?:[^\p{{L}}\p{{N}}_]*[\p{{L}}\p{{N}}_]+){{{n}}}')"
    return f"CASE WHEN {wc(expr)} > {n} THEN {head} || ' …' ELSE {expr} END"


def syllables(expr: str) -> str:
    """Vowel groups of one word."""
    w = rf"regexp_replace(lower({expr}), '[^a-záéíóúüñ]', '', 'g')"
    folded = f"regexp_replace({w}, 'y$', 'i')"
    for pattern in ("[iuü][aáeéoó][iuü]", "[aáeéoó][iuü]", "[iuü][aáeéoó]", "[iuü]{2}"):
        folded = f"regexp_replace({folded}, '{pattern}', 'a', 'g')"
    return (
        f"CASE WHEN length({w}) = 0 THEN 0 WHEN length({w}) <= 2 THEN 1 "
        f"ELSE greatest(1, len(regexp_extract_all({folded}, '[aeiouáéíóúü]'))) END"
    )


ABBREVIATIONS = quoted(cfg.ABBREVIATIONS)
VERBS = quoted(cfg.ACTION_VERBS)
ENCLITIC = "(?:" + "|".join(cfg.ENCLITICS) + ")$"


def is_action(token: str) -> str:
    return (
        f"({token} IN ({VERBS}) OR (regexp_matches({token}, '^.{{4,}}{ENCLITIC}') "
        f"AND regexp_replace({token}, '{ENCLITIC}', '') IN ({VERBS})))"
    )


VIEWS: dict[str, str] = {
    "para_lists": rf"""
SELECT doc_id, list_filter(list_transform(string_split_regex(raw_text, '[\n\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'),
  lambda x: {trim('x')}), lambda x: x <> '') AS ps FROM materials""",
    "paragraphs": f"""
SELECT doc_id, pos, text, {wc('text')} AS words FROM (
  SELECT doc_id, CAST(generate_subscripts(ps, 1) AS INT) AS pos, unnest(ps) AS text FROM para_lists)""",
    "tokens": rf"""
SELECT doc_id, para, CAST(generate_subscripts(ts, 1) AS INT) AS i, unnest(ts) AS piece FROM (
  SELECT doc_id, pos AS para, regexp_extract_all(text, '{NOT_WS}+{WS}*') AS ts FROM paragraphs)""",
    "token_ends": rf"""
SELECT *, regexp_extract(tok, '([.!?]+|…){CLOSERS}$', 1) AS term,
  regexp_replace(tok, '(?:[.!?]+|…){CLOSERS}$', '') AS stem,
  lead(tok) OVER w AS next_tok, lag(tok) OVER w AS prev_tok
FROM (SELECT doc_id, para, i, piece, {trim('piece')} AS tok FROM tokens)
WINDOW w AS (PARTITION BY doc_id, para ORDER BY i)""",
    "token_breaks": rf"""
SELECT *, CASE
  WHEN term = '' OR next_tok IS NULL OR regexp_matches(next_tok, '^[\p{{Ll}}ªº]') THEN false
  WHEN term[1] <> '.' OR term[1:2] = '..' THEN true
  ELSE lower(last_word) NOT IN ({ABBREVIATIONS}) AND NOT regexp_full_match(last_word, '\p{{Lu}}') END AS is_break
FROM (SELECT *, regexp_replace(CASE WHEN stem = '' THEN coalesce(prev_tok, '') ELSE stem END, '^[(\[¿¡"''«]+', '') AS last_word FROM token_ends)""",
    "token_runs": """
SELECT *, sum(CASE WHEN prev_break THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, para ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
FROM (SELECT *, coalesce(lag(is_break) OVER (PARTITION BY doc_id, para ORDER BY i), false) AS prev_break FROM token_breaks)""",
    "token_pieces": rf"""
SELECT doc_id, para, run, string_agg(piece, '' ORDER BY i) AS piece,
  regexp_full_match(string_agg(piece, '' ORDER BY i), '{WS}*(?:[0-9]{{1,2}}|[a-zA-Z]){WS}*\.(?:[!?][.!?]*)?{CLOSERS}{WS}*') AND bool_or(is_break) AS lone_marker
FROM token_runs GROUP BY doc_id, para, run""",
    "piece_markers": """
SELECT *, row_number() OVER (PARTITION BY doc_id, para, lone_marker, island ORDER BY run) AS marker_rank FROM (
  SELECT *, run - row_number() OVER (PARTITION BY doc_id, para, lone_marker ORDER BY run) AS island FROM token_pieces)""",
    "piece_groups": """
SELECT *, sum(CASE WHEN joins_previous THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, para ORDER BY run ROWS UNBOUNDED PRECEDING) AS sent FROM (
  SELECT *, coalesce(lag(lone_marker AND marker_rank % 2 = 1) OVER (PARTITION BY doc_id, para ORDER BY run), false) AS joins_previous FROM piece_markers)""",
    "sentences": f"""
SELECT doc_id, para, CAST(row_number() OVER (PARTITION BY doc_id, para ORDER BY sent) AS INT) AS pos, text, {wc('text')} AS words FROM (
  SELECT doc_id, para, sent, {trim("string_agg(piece, '' ORDER BY run)")} AS text FROM piece_groups GROUP BY doc_id, para, sent)
WHERE text <> ''""",
    "doc_sentences": """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para, pos) AS INT) AS pos, text, words FROM sentences WHERE words > 0""",
    "sentence_words": rf"""
SELECT doc_id, pos, CAST(generate_subscripts(ws, 1) AS INT) AS i, lower(unnest(ws)) AS word FROM (
  SELECT doc_id, pos, regexp_extract_all(text, '{WORD}') AS ws FROM doc_sentences)""",
    "sentence_actions": f"""
SELECT doc_id, pos, count(*) AS actions FROM sentence_words WHERE {is_action('word')} GROUP BY doc_id, pos""",
    "doc_words": rf"""
SELECT doc_id, unnest(regexp_extract_all(raw_text, '{WORD}')) AS word FROM materials""",
    "readable": rf"""
SELECT doc_id, CASE WHEN n >= {cfg.MIN_WORDS_FOR_READABILITY} AND s > 0
  THEN round_even(206.835::DOUBLE - 62.3::DOUBLE * (syl / n) - (n / s), 1) END AS readability FROM (
  SELECT doc_id, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n * syllables) AS DOUBLE) AS syl FROM (
    SELECT doc_id, word, count(*) AS n, {syllables('word')} AS syllables FROM doc_words
    WHERE NOT regexp_full_match(word, '[\p{{Nd}}²³¹⁰⁴-⁹₀-₉]+') GROUP BY doc_id, word) GROUP BY doc_id) w
LEFT JOIN (SELECT doc_id, CAST(count(*) AS DOUBLE) AS s FROM doc_sentences GROUP BY doc_id) c USING (doc_id)""",
    "sized": rf"""
SELECT m.*, {wc('raw_text')} AS word_count,
  source_type = 'pdf' AND ({wc('raw_text')} = 0 OR ({wc('raw_text')} < {cfg.SCANNED_MAX_WORDS} AND image_count >= page_count)) AS is_scanned
FROM materials m""",
    "heading_steps": """
SELECT doc_id, pos, level, text, lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS previous_level FROM headings""",
    "heading_totals": """
SELECT doc_id, CAST(count(*) AS INT) AS heading_count, CAST(count(DISTINCT level) AS INT) AS hierarchy_levels,
  CAST(count(*) FILTER (WHERE level > previous_level + 1) AS INT) AS skip_count FROM heading_steps GROUP BY doc_id""",
    "section_marks": """
SELECT p.doc_id, p.pos, p.text, p.words, EXISTS (SELECT 1 FROM headings h WHERE h.doc_id = p.doc_id
    AND (contains(lower(p.text), lower(h.text)) OR contains(lower(h.text), lower(p.text)))) AS is_head
FROM paragraphs p JOIN sized z USING (doc_id) WHERE z.source_type <> 'text' AND NOT z.is_scanned AND p.doc_id IN (SELECT doc_id FROM headings)""",
    "section_islands": """
SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM section_marks""",
    "long_section_rows": f"""
SELECT s.doc_id, island, coalesce(head, first_heading) AS head, words FROM (
  SELECT doc_id, island, max(CASE WHEN is_head THEN text END) AS head, CAST(sum(CASE WHEN is_head THEN 0 ELSE words END) AS INT) AS words
  FROM section_islands GROUP BY doc_id, island) s
JOIN (SELECT doc_id, text AS first_heading FROM headings WHERE pos = 1) f ON f.doc_id = s.doc_id
WHERE words > {cfg.LONG_SECTION_WORDS}""",
    "run_sets": """
SELECT *, row_number() OVER (PARTITION BY sample, mode ORDER BY a, t, u) AS k FROM (
  SELECT user_id % 20 AS sample, 'v' || (event_id % 2) AS mode, event_id % 5 AS a, event_type AS t, user_id % 3 AS u, count(*) AS n FROM events GROUP BY 1, 2, 3, 4, 5)""",
}
