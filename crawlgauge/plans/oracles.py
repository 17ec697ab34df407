"""DuckDB SQL for the page queries: the same measures taken from the HTML by regular expressions."""

from __future__ import annotations

from ..functions import fixed, text


def _decoded(x: str) -> str:
    """Tags out, then the entities that the pages use; &amp; through a placeholder so that nothing is decoded twice."""
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    x = f"regexp_replace({x}, '&amp;?', chr(1), 'g')"
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"replace({x}, chr(1), '&')"


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _elements(tags: str) -> str:
    return "|".join(rf"<{t}\b.*?(?:</{t}\s*>|$)" for t in tags.split())


_QUESTION = rf"(?i)^\s*(?:(?:{text.ASCII_OPENERS})([^A-Za-z0-9_]|$)|(?:{text.OTHER_OPENERS})[A-Za-z0-9_])|\?\s*$"
_STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)
_GENERIC = ", ".join(f"'{a}'" for a in fixed.GENERIC_ANCHORS)
GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"
TENTH = "floor(({0}) * 10 + 0.5) / 10"

BASE = rf"""
WITH src AS (
  SELECT page_id, url, html, CAST(octet_length(encode(html)) AS BIGINT) AS bytes,
         regexp_replace(html, '(?is){_elements("script style noscript template svg iframe")}|<!--.*?-->', '', 'g') AS bare FROM pages),
parts AS (
  SELECT *, regexp_extract(bare, '(?is)<article[^>]*>(.*?)(?:</article>|$)', 1) AS article,
         regexp_replace(regexp_extract(bare, '(?is)<body[^>]*>(.*)$', 1), '(?is){_elements("header nav footer aside")}', '', 'g') AS rest FROM src),
texts AS (
  SELECT *, {_decoded("article")} AS article_text, {_decoded("rest")} AS rest_text FROM parts),
mains AS (
  SELECT *, length(trim(article_text)) > 200 AS landmark,
         {_collapsed("CASE WHEN length(trim(article_text)) > 200 THEN article_text ELSE rest_text END")} AS body_text,
         nullif(trim({_decoded("regexp_extract(bare, '(?is)<title[^>]*>(.*?)</title>', 1)")}), '') AS title,
         nullif(regexp_extract(html, '(?i)<html[^>]* lang="([^"]*)"', 1), '') AS lang,
         nullif(regexp_extract(html, '(?i)<meta charset="([^"]*)"', 1), '') AS charset,
         list_transform(regexp_extract_all(bare, '(?is)<h[1-6][^>]*>.*?</h[1-6]>'), lambda h: {_collapsed(_decoded("h"))}) AS heading_texts,
         list_transform(regexp_extract_all(bare, '(?is)<h[1-6][^>]*>.*?</h[1-6]>'), lambda h: CAST(h[3] AS INTEGER)) AS heading_levels,
         regexp_extract_all(bare, '(?is)<a href="[^"]*">.*?</a>') AS anchors,
         len(regexp_extract_all(bare, '(?i)<p[ >]')) AS paragraph_count,
         len(regexp_extract_all(bare, '(?i)<(ul|ol|table|dl)[ >]')) AS blocks,
         coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), lambda s: octet_length(encode(s)))), 0) AS script_bytes,
         lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme
  FROM texts),
counted AS (
  SELECT *, list_filter(string_split(body_text, ' '), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]')) AS word_list,
         greatest(1, len(list_filter(string_split_regex(body_text, '[.!?¿¡]+(?:\s|$)'), lambda s: trim(s) <> ''))) AS sentence_count,
         len(list_filter(heading_texts, lambda h: h <> '')) AS headings, len(list_filter(heading_levels, lambda l: l = 1)) AS h1_count,
         len(list_filter(heading_texts, lambda h: regexp_matches(h, '{_QUESTION}'))) AS questions,
         len(anchors) AS total_links,
         len(list_filter(anchors, lambda a: lower({_collapsed(_decoded("a"))}) IN ({_GENERIC}))) AS generic_count,
         len(list_filter(anchors, lambda a: {_collapsed(_decoded("a"))} = '')) AS empty_anchors,
         coalesce(length(title), 0) AS title_length
  FROM mains),
spoken AS (
  SELECT *, len(word_list) AS word_count,
         coalesce(list_sum(list_transform(list_transform(word_list, lambda w: regexp_replace(lower(w), '[^a-záéíóúüñ]', '', 'g')),
           lambda w: CASE WHEN w = '' THEN 0 ELSE greatest(1, greatest(1, len(regexp_extract_all(w, '[aeiouyáéíóúü]+')))
             - CASE WHEN length(w) > 2 AND w LIKE '%e' AND NOT regexp_matches(w, '[aeiouy]e$') THEN 1 ELSE 0 END) END)), 0) AS syllable_count
  FROM counted),
eased AS (
  SELECT *, CASE WHEN word_count = 0 THEN 0 ELSE {TENTH.format("206.835::DOUBLE - 1.015::DOUBLE * (word_count / sentence_count) - 84.6::DOUBLE * (syllable_count / word_count)")} END AS reading_ease,
         {TENTH.format("word_count / sentence_count")} AS avg_words_per_sentence, word_count < {fixed.THIN_WORDS} AS thin_content,
         {TENTH.format("octet_length(encode(body_text)) / bytes * 100")} AS text_to_html_ratio
  FROM spoken),
scored AS (
  SELECT *,
    CASE WHEN title IS NULL THEN 0 WHEN title_length < 30 THEN 15 WHEN title_length > 60 THEN 18 ELSE 25 END + 15
      + CASE WHEN lang IS NULL THEN 0 ELSE 8 END + CASE WHEN charset IS NULL THEN 0 ELSE 7 END AS meta_score,
    CASE h1_count WHEN 0 THEN 0 WHEN 1 THEN 40 ELSE 20 END + CASE WHEN headings >= 2 THEN 25 ELSE 0 END + 20 + 5 + CASE WHEN questions > 0 THEN 10 ELSE 0 END AS heading_score,
    CASE WHEN thin_content THEN 10 ELSE 35 END + CASE WHEN landmark THEN 15 ELSE 0 END + CASE WHEN reading_ease >= 50 THEN 20 ELSE 8 END
      + CASE WHEN avg_words_per_sentence <= 25 THEN 15 ELSE 0 END + CASE WHEN paragraph_count < 3 AND word_count > 200 THEN 0 ELSE 10 END
      + CASE WHEN text_to_html_ratio < 5 AND bytes > 50000 THEN 0 ELSE 5 END AS content_score,
    CASE WHEN total_links = 0 THEN 0 WHEN total_links < 3 THEN 15 ELSE 35 END + 10 + CASE WHEN empty_anchors = 0 THEN 15 ELSE 0 END + greatest(0, 20 - 2 * generic_count) + 10 AS links_score,
    word_count >= 100 AS renders
  FROM eased),
judged AS (
  SELECT *, CAST(floor((floor(meta_score * 0.75 + 0.5) * 25 + heading_score * 15 + content_score * 15 + 100 * 10 + links_score * 10 + 50 * 10) / 100 + 0.5) AS INTEGER) AS seo_score,
    25 + CASE WHEN renders THEN 20 ELSE 8 END + CASE WHEN h1_count = 1 THEN 4 ELSE 0 END + CASE WHEN headings >= 3 THEN 4 ELSE 0 END + CASE WHEN blocks > 0 THEN 4 ELSE 0 END
      + CASE WHEN questions > 0 THEN 3 ELSE 0 END + CASE WHEN thin_content THEN 0 ELSE 4 END + CASE WHEN reading_ease >= 45 THEN 2 ELSE 0 END + CASE WHEN avg_words_per_sentence <= 25 THEN 1 ELSE 0 END AS geo_score
  FROM scored),
terms AS (
  SELECT page_id, word_count, unnest(word_list) AS word, generate_subscripts(word_list, 1) AS pos FROM spoken),
kept_terms AS (
  SELECT page_id, word_count, pos, regexp_replace(lower(word), '[^\p{{L}}\p{{N}}-]', '', 'g') AS term FROM terms)
"""

_LEVEL = (
    "CASE WHEN reading_ease >= 90 THEN 'very_easy' WHEN reading_ease >= 80 THEN 'easy' WHEN reading_ease >= 70 THEN 'fairly_easy' WHEN reading_ease >= 60 THEN 'plain' "
    "WHEN reading_ease >= 50 THEN 'fairly_difficult' WHEN reading_ease >= 30 THEN 'university' ELSE 'graduate' END"
)
_INT = "CAST({0} AS INTEGER) AS {0}"


def _ints(*names: str) -> str:
    return ", ".join(_INT.format(n) for n in names)


_KEPT = f"length(term) >= 4 AND term NOT IN ({_STOP})"
_NORMAL = """scheme || '://' || host || CASE WHEN regexp_replace(p, '/+$', '') = '' THEN '/' ELSE regexp_replace(p, '/+$', '') END || q"""

#: Codes that the rules give a page; the pages have neither descriptions, canonical links, viewports, images nor structured data.
_META = """CASE WHEN title IS NULL THEN 'fail:title_missing' WHEN title_length < 30 THEN 'warn:title_short' WHEN title_length > 60 THEN 'warn:title_long' ELSE 'pass:title_ok' END, 'fail:description_missing', 'warn:canonical_missing', 'pass:indexable',
  CASE WHEN lang IS NULL THEN 'warn:lang_missing' ELSE 'pass:lang_declared' END, CASE WHEN charset IS NULL THEN 'warn:charset_missing' END, 'fail:viewport_missing'"""
_HEADING = """CASE h1_count WHEN 0 THEN 'fail:h1_missing' WHEN 1 THEN 'pass:h1_single' ELSE 'warn:h1_several' END, CASE WHEN headings < 2 THEN 'warn:headings_few' ELSE 'pass:headings_enough' END, 'pass:levels_in_order',
  CASE WHEN len(heading_texts) > headings THEN 'warn:headings_empty' END, CASE WHEN questions > 0 THEN 'pass:questions_present' ELSE 'info:questions_absent' END"""
_CONTENT = f"""CASE WHEN thin_content THEN 'warn:content_thin' ELSE 'pass:content_deep' END, CASE WHEN landmark THEN 'pass:landmark_present' ELSE 'warn:landmark_missing' END, CASE WHEN reading_ease >= 50 THEN 'pass:easy_to_read' ELSE 'warn:hard_to_read' END,
  CASE WHEN avg_words_per_sentence > 25 THEN 'warn:sentences_long' END, CASE WHEN paragraph_count < 3 AND word_count > 200 THEN 'warn:paragraphs_few' END, CASE WHEN text_to_html_ratio < 5 AND bytes > 50000 THEN 'warn:text_ratio_low' END, CASE WHEN bytes > {fixed.HEAVY_HTML} THEN 'warn:html_heavy' END"""
_LINK = """CASE WHEN total_links = 0 THEN 'fail:internal_none' WHEN total_links < 3 THEN 'warn:internal_few' ELSE 'pass:internal_enough' END, 'info:external_none', CASE WHEN empty_anchors > 0 THEN 'warn:anchors_empty' END,
  CASE WHEN generic_count = 0 THEN 'pass:generic_none' ELSE 'warn:generic_some' END, 'info:broken_unchecked'"""
_RENDER = "CASE WHEN renders THEN 'pass:renders' ELSE 'warn:words_few' END, CASE WHEN script_bytes > 0.5 * bytes AND bytes > 50000 THEN 'warn:script_heavy' END"


def _worst(codes: str) -> str:
    """Codes of three findings at most, failures first."""
    of = lambda severity: f"list_transform(list_filter([{codes}], lambda x: x LIKE '{severity}:%'), lambda x: substr(x, 6))"
    return f"array_to_string(list_concat({of('fail')}, {of('warn')})[1:3], ',')"


def _level(score: str, section: str) -> str:
    return f"CASE WHEN {score} >= 80 THEN 'pass' WHEN {score} >= 60 THEN 'warn' ELSE 'fail' END || ':{section}'"


def _signal(earned: str, weight: int, name: str) -> str:
    return f"CASE WHEN ({earned}) / {weight} >= 0.85 THEN 'pass' WHEN ({earned}) / {weight} >= 0.4 THEN 'warn' ELSE 'fail' END || ':{name}'"


_EXTRACT = "CASE WHEN h1_count = 1 THEN 4 ELSE 0 END + CASE WHEN headings >= 3 THEN 4 ELSE 0 END + CASE WHEN blocks > 0 THEN 4 ELSE 0 END + CASE WHEN questions > 0 THEN 3 ELSE 0 END"
_DEPTH = "CASE WHEN thin_content THEN 0 ELSE 4 END + CASE WHEN reading_ease >= 45 THEN 2 ELSE 0 END + CASE WHEN avg_words_per_sentence <= 25 THEN 1 ELSE 0 END"

SQL = {
    "json_results": BASE + f""", j AS (SELECT page_id, CAST(to_json({{'page_id': page_id, 'title': title, 'h1_count': h1_count, 'words': word_list[1:{fixed.LIST_MOST}], 'lists_cut': CASE WHEN word_count > {fixed.LIST_MOST} THEN 1 ELSE 0 END}}) AS VARCHAR) AS t FROM spoken)
        SELECT page_id, CASE WHEN length(t) > 1500 THEN t[1:1500] || chr(10) || chr(10) || '[' || (length(t) - 1500) || ' characters left out]' ELSE t END AS "text" FROM j""",
    "page_findings": BASE + f"SELECT page_id, concat_ws(',', {_META}) AS meta_codes, concat_ws(',', {_HEADING}) AS heading_codes, concat_ws(',', {_CONTENT}) AS content_codes, concat_ws(',', {_LINK}) AS link_codes, concat_ws(',', {_RENDER}) AS render_codes FROM scored",
    "seo_recommendations": BASE + f"""SELECT page_id,
        concat_ws(',', CASE WHEN seo_score >= 80 THEN 'pass:overall' ELSE 'info:overall' END, {_level("floor(meta_score * 0.75 + 0.5)", "meta")}, {_level("heading_score", "headings")}, {_level("content_score", "content")}, 'fail:structured_data', 'pass:images', {_level("links_score", "links")}, 'fail:robots') AS findings,
        concat_ws(',', 'pass:crawler_access', CASE WHEN renders THEN 'pass' ELSE 'warn' END || ':server_rendering', 'fail:structured_data', {_signal(_EXTRACT, 15, "extractable_structure")}, 'fail:attribution', 'fail:freshness', {_signal(_DEPTH, 7, "depth")}) AS geo_signals,
        {_worst(_META + ", 'fail:og_image_missing'")} AS meta_issues, {_worst(_HEADING)} AS headings_issues, {_worst(_CONTENT)} AS content_issues, 'schema_none,publisher_none' AS structured_data_issues, '' AS images_issues, {_worst(_LINK)} AS links_issues, '' AS robots_issues,
        array_to_string(list_filter(list_concat([CASE WHEN title IS NULL THEN 'add_title' END, 'add_description', CASE WHEN h1_count = 0 THEN 'add_h1' END, 'add_structured_data', CASE WHEN thin_content THEN 'extend_content' END, 'add_canonical'],
          list_filter([CASE WHEN NOT renders THEN 'improve_server_rendering' END, 'improve_structured_data', CASE WHEN {_EXTRACT} < 12 THEN 'improve_extractable_structure' END, 'improve_attribution', 'improve_freshness', CASE WHEN {_DEPTH} < 5 THEN 'improve_depth' END], lambda x: x IS NOT NULL)[1:5]), lambda x: x IS NOT NULL)[1:8], ',') AS recommendations FROM judged""",
    "capped_lists": BASE + f"""SELECT page_id, CAST(CASE WHEN headings > {fixed.LIST_MOST} THEN 1 ELSE 0 END + CASE WHEN word_count > {fixed.LIST_MOST} THEN 1 ELSE 0 END AS INTEGER) AS lists_cut, CAST(least(headings, {fixed.LIST_MOST}) AS INTEGER) AS headings, md5(array_to_string(word_list[1:{fixed.LIST_MOST}], ' ')) AS words_md5,
        CASE WHEN greatest(headings, word_count) > {fixed.LIST_MOST} THEN 'lists_cut' WHEN headings < 2 THEN 'headings_few' ELSE 'headings_enough' END AS last_finding FROM spoken""",
    "page_title_length": BASE + f"SELECT page_id, title, {_ints('title_length')} FROM counted",
    "page_lang_counts": BASE + "SELECT lang, count(*) AS pages FROM mains GROUP BY lang",
    "page_charset": BASE + "SELECT page_id, charset FROM mains",
    "heading_outline": BASE + f"""SELECT page_id, array_to_string(list_transform(range(1, len(heading_texts) + 1),
        lambda i: repeat('  ', heading_levels[i] - 1) || 'H' || heading_levels[i] || ' ' || heading_texts[i]), chr(10)) AS outline, {_ints('h1_count')}, CAST(0 AS INTEGER) AS level_skips FROM counted""",
    "heading_question_flag": BASE + f"SELECT page_id, {_ints('questions')} FROM counted",
    "word_count": BASE + f"SELECT page_id, {_ints('word_count')}, landmark FROM spoken",
    "sentence_stats": BASE + f"SELECT page_id, {_ints('sentence_count')}, avg_words_per_sentence, CAST(greatest(1, floor(word_count / 220 + 0.5)) AS INTEGER) AS reading_time_minutes FROM eased",
    "reading_ease": BASE + f"SELECT page_id, {_ints('syllable_count')}, reading_ease, {_LEVEL} AS reading_level FROM eased",
    "flesch_by_lang": BASE + "SELECT lang, count(*) AS pages, CAST(sum(CAST(floor(reading_ease * 10 + 0.5) AS BIGINT)) AS BIGINT) AS ease_tenths FROM eased GROUP BY lang",
    "top_terms": BASE + f""", each AS (SELECT page_id, word_count, term, count(*) AS n, min(pos) AS first FROM kept_terms WHERE {_KEPT} GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS r FROM each)
        SELECT page_id, term, n AS "count", floor(n / word_count * 10000 + 0.5) / 100 AS density, CAST(r AS INTEGER) AS "rank" FROM ranked WHERE r <= 15""",
    "term_stopword_anti_join": BASE + f"SELECT page_id, count(*) AS terms, count(DISTINCT term) AS distinct_terms FROM kept_terms WHERE {_KEPT} GROUP BY page_id",
    "text_html_ratio": BASE + "SELECT page_id, bytes, text_to_html_ratio FROM eased",
    "paragraph_count": BASE + f"SELECT page_id, {_ints('paragraph_count')} FROM mains",
    "script_bytes": BASE + "SELECT page_id, CAST(script_bytes AS INTEGER) AS script_bytes FROM mains",
    "links_internal_external": BASE + f"SELECT page_id, {_ints('total_links')}, CAST(total_links AS INTEGER) AS internal_links, CAST(0 AS INTEGER) AS external_links FROM counted",
    "generic_anchor": BASE + f"SELECT page_id, {_ints('generic_count', 'empty_anchors')} FROM counted",
    "host_page_counts": BASE + "SELECT host, count(*) AS pages, count(*) FILTER (scheme = 'https') AS https_pages FROM mains GROUP BY host",
    "https_share": BASE + "SELECT scheme, count(*) AS pages FROM mains GROUP BY scheme",
    "url_normalised_dups": f"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
        regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(regexp_replace(url, '#.*$', ''), '(\\?.*)$', 1) AS q FROM pages)
        SELECT {_NORMAL} AS normalised, count(*) AS pages FROM u GROUP BY 1""",
    "meta_score": BASE + f"SELECT page_id, {_ints('meta_score')}, {GRADE.format('meta_score')} AS meta_grade FROM scored",
    "heading_score": BASE + f"SELECT page_id, {_ints('heading_score')}, {GRADE.format('heading_score')} AS heading_grade FROM scored",
    "content_score": BASE + f"SELECT page_id, {_ints('content_score')}, {GRADE.format('content_score')} AS content_grade FROM scored",
    "links_score": BASE + f"SELECT page_id, {_ints('links_score')}, {GRADE.format('links_score')} AS links_grade FROM scored",
    "rendering": BASE + "SELECT page_id, renders AS renders_without_js, false AS spa_shell_detected, CAST(script_bytes AS INTEGER) AS inline_script_bytes FROM scored",
    "geo_depth": BASE + "SELECT page_id, CAST(CASE WHEN thin_content THEN 0 ELSE 4 END + CASE WHEN reading_ease >= 45 THEN 2 ELSE 0 END + CASE WHEN avg_words_per_sentence <= 25 THEN 1 ELSE 0 END AS INTEGER) AS earned FROM eased",
    "seo_overall": BASE + f"SELECT page_id, seo_score, {GRADE.format('seo_score')} AS seo_grade FROM judged",
    "geo_overall": BASE + f"SELECT page_id, {_ints('geo_score')}, {GRADE.format('geo_score')} AS geo_grade FROM judged",
    "grade_histogram": BASE + f"SELECT host, {GRADE.format('seo_score')} AS grade, count(*) AS pages FROM judged GROUP BY ALL",
}
