"""Queries of text functions and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Cleaning
from tessera.functions import predicates as P
from tessera.functions import text as T
from tessera.functions import tokens as K
from tessera.plans.common import COUNT, FIRSTS, LIGHT, LINES, OPENERS, PLAIN, RAW, STEMMED, STRIP, WORDS, firsts, lines, table

#: Rows that hold what the synthetic documents don't: merged words, citations, split ligatures.
PROBES = {
    -1: "The treatmentYour doctor said.Then rest,Take care (now)And wait .  Done",
    -2: "Shown before [1, 2-5] and (3), also (1,2) in (1990) but (19901) not ( 2004 ) .",
    -3: "strati fi cation of the fi nal fl uid and a cu ff in o ffi ce",
    -4: "ordinary words, nothing to mend.",
}
_PROBES = "(VALUES " + ", ".join(f"({k}::BIGINT, '{v}')" for k, v in PROBES.items()) + ") p(doc_id, text)"
_WITH = f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {_PROBES})"


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(list(PROBES.items()), "doc_id long, text string"))


def tokens_plain(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(K.plain(F.col("text")), " ").alias("tokens"))


def tokens_stemmed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(K.stemmed(F.col("text")), " ").alias("tokens"))


def tokens_longer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(K.longer(F.col("text")), " ").alias("tokens"))


def content_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(K.terms(F.col("text"))).cast("long").alias("n_terms"))


def clean_ocr_ws(spark, sf_dir):
    return _probed(spark, sf_dir).select("doc_id", T.squeeze(T.fix_ocr_merges(F.col("text"))).alias("cleaned"))


def strip_citations(spark, sf_dir):
    return _probed(spark, sf_dir).select("doc_id", T.strip_citations(F.col("text")).alias("cleaned"))


def ligature_fix(spark, sf_dir):
    return _probed(spark, sf_dir).select("doc_id", T.fix_ligatures(F.col("text")).alias("cleaned"))


def word_stats_histogram(spark, sf_dir):
    from tessera.operators import validation

    return validation.word_histogram(table(spark, sf_dir, "documents"), "text")


def source_name_pretty(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.pretty_source(F.col("url")).alias("title"))


def heading_features(spark, sf_dir):
    h = F.col("heading")
    return firsts(spark, sf_dir).select("doc_id", F.round(T.upper_ratio(h), 6).alias("upper_ratio"), T.title_words(h).cast("long").alias("title_words"), T.word_count(h).cast("long").alias("words"), P.is_heading_like(h).alias("heading_like"))


def match_keys(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(T.match_key(F.col("line")).alias("norm")).agg(F.count("*").alias("n"))


def line_flags(spark, sf_dir):
    x, c = F.col("line"), Cleaning()
    flags = {"artifacts": T.is_artifact(x, c.known_artifacts, c.noise_patterns), "toc_lines": P.is_toc_line(x), "bullets": P.is_bullet(x), "urls": P.is_url(x), "symbols": P.is_symbol_noise(x), "bibliography": P.is_bibliography(x), "references": P.is_references(x), "toc_like": P.is_toc_like(x)}
    return lines(spark, sf_dir).groupBy("source").agg(F.count("*").alias("lines"), *[F.count_if(v).alias(k) for k, v in flags.items()])


def start_flags(spark, sf_dir):
    x = F.col("line")
    n = T.word_count(x)
    flags = {"lower_start": K.starts_lower(x), "transition": K.is_transition(x), "pronoun": K.is_pronoun(x), "awkward": K.is_awkward_start(x, n), "orphan": K.is_orphan(x, n)}
    return lines(spark, sf_dir).groupBy("source").agg(*[F.count_if(v).alias(k) for k, v in flags.items()])


def search_texts(spark, sf_dir):
    d = firsts(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    levels = [F.col("source"), F.col("lang")]
    return d.select("doc_id", *[F.md5(T.search_text(k, F.col("heading"), levels, F.col("content"))).alias(k + "_md5") for k in ("content", "all", "path", "lines", "titled")])


def vignette_flag(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", P.is_vignette(F.col("text"), ("year-old",)).alias("vignette"), F.length("text").cast("long").alias("chars"))


def metadata_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(P.metadata({"lang": ["en", "de"], "source": "src1"}) & P.contains_any_case("text", "THE"))
    return d.select("doc_id", "lang", "source")


def suspicious_merges(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(T.suspicious_merges(F.col("text"))).cast("long").alias("merges"))


def optimized_queries(spark, sf_dir):
    q = T.optimized_query(F.col("text"), {"to be": "existence"}, {"teh": "the"}, {"th": "thorium", "nt": "notation"}, {"the": ["article", "determiner"]}, ("stroke",))
    return table(spark, sf_dir, "benchmark").select("item_id", q.alias("q")).select("item_id", F.col("q.optimized").alias("optimized"), F.array_join("q.terms", "|").alias("terms"), F.col("q.confidence").alias("confidence"), F.col("q.emergency").alias("emergency"))


_FLAT = STRIP.format(r"regexp_replace({0}, '\s+', ' ', 'g')")
_TOC = r"(regexp_matches({0}, '^[A-Z][A-Za-z''()/,& -]+\s+\d{{1,3}}(?:[-–]\d{{1,3}})?$') OR (regexp_matches({0}, '^\d+\s+[A-Z]') AND len(list_filter(string_split({0}, ' '), lambda x: x <> '')) <= 6))"
_N = lambda text, pattern: f"len(regexp_extract_all({text}, '{pattern}'))"
_FIRST = "lower(regexp_extract(line, '[A-Za-z'']+'))"
_IN = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"

_SYMBOLS = r"regexp_full_match(b, '[®Ü•*=\-_/|]+')"
_FLAGS = {
    "artifacts": r"b IN ('Ü') OR regexp_full_match(b, '\d+') OR regexp_full_match(b, '[®Ü•*=\-_/|]+')",
    "toc_lines": _TOC.format("f"),
    "bullets": r"regexp_matches(line, '^\s*[-*•●◦▪▸►‣⁃]\s|^\s*\d+[.)]\s|^\s*[a-zA-Z][.)]\s')",
    "urls": r"regexp_matches(line, '(?i)https?://|www\.|\b\S+\.(?:org|com|edu|gov)\b')",
    "symbols": _SYMBOLS,
    "bibliography": "n >= 3 AND ((" + _N("line", r"\b(?:19\d{2}|20[0-2]\d)\b") + " >= 2 AND " + _N("line", r"(?i)\b(?:J Clin|N Engl J Med|Lancet|JAMA|BMJ|guideline|guidelines)\b") + " >= 1) OR (" + _N("line", r"\b(?:19\d{2}|20[0-2]\d)\b") + " >= 1 AND " + _N("line", r"(?i)\b(?:et al\.|pp\.|vol\.|journal|clinical trial|recommendation|consensus)\b") + r" >= 2) OR regexp_matches(line, '\A\d+[.)]\s+')::INT + regexp_matches(line, '\A\[\d+\]\s+')::INT >= 2)",
    "references": "contains(upper(line), 'REFERENCES')",
    "toc_like": _N("line[:220]", r"\b\d+\s+[A-Za-z]") + " >= 3",
}
_UPPER = r"CASE WHEN len(regexp_extract_all({0}, '\p{{L}}')) > 0 THEN len(regexp_extract_all({0}, '\p{{Lu}}')) / len(regexp_extract_all({0}, '\p{{L}}')) ELSE 0 END"
_TITLE = rf"len(list_filter({WORDS}, lambda x: regexp_matches(x, '\A\p{{{{Lu}}}}')))"
_PATH = "concat_ws(' > ', nullif(source, ''), nullif(lang, ''), CASE WHEN trim(heading) <> '' THEN heading END)"
_PART = lambda c: f"CASE WHEN {STRIP.format(c)} <> '' THEN {c} END"

SQL = {
    "tokens_plain": f"SELECT doc_id, array_to_string({PLAIN.format('text')}, ' ') AS tokens FROM documents",
    "tokens_stemmed": f"SELECT doc_id, array_to_string({STEMMED.format('text')}, ' ') AS tokens FROM documents",
    "tokens_longer": f"SELECT doc_id, array_to_string(list_filter({RAW.format('text')}, lambda t: len(t) > 1), ' ') AS tokens FROM documents",
    "content_terms": f"SELECT doc_id, len(list_distinct(list_filter({STEMMED.format('text')}, lambda t: NOT list_contains([{', '.join(repr(w) for w in K.STOP_WORDS)}], t))))::BIGINT AS n_terms FROM documents",
    "clean_ocr_ws": "SELECT doc_id, " + STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([a-z])([A-Z][a-z]{2,})', '\1 \2', 'g'), '(\.)([A-Z][a-z])', '\1 \2', 'g'), '(,)([A-Z])', '\1 \2', 'g'), '(\))([A-Z][a-z])', '\1 \2', 'g'), '[ \t]+', ' ', 'g'), ' \.', '.', 'g')") + f" AS cleaned FROM {_WITH}",
    # RE2 has no lookahead: single years are set aside and put back
    "strip_citations": "SELECT doc_id, " + STRIP.format(r"regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '\[[\d\s,\-–]+\]', '', 'g'), '\((\s*(?:19|20)\d{2}\s*)\)', '⟦\1⟧', 'g'), '\(\s*\d+(?:\s*[,\-–]\s*\d+)*\s*\)', '', 'g'), '⟦', '('), '⟧', ')'), '\s+([.,;:?])', '\1', 'g'), '\s+', ' ', 'g')") + f" AS cleaned FROM {_WITH}",
    "ligature_fix": r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, '–', '-'), '—', '-'), '‐', '-'), '\b([a-zA-Z]+)\s+(fi|fl|ff|ffi|ffl)\s+([a-zA-Z]+)\b', '\1\2\3', 'g'), '\b(fi|fl|ff|ffi|ffl)\s+([a-zA-Z]+)\b', '\1\2', 'g'), '\b([a-zA-Z]+)\s+(fi|fl|ff|ffi|ffl)\b', '\1\2', 'g') AS cleaned FROM " + _WITH,
    "word_stats_histogram": f"SELECT CASE WHEN n < 50 THEN '0-49' WHEN n < 100 THEN '50-99' WHEN n < 200 THEN '100-199' WHEN n < 400 THEN '200-399' WHEN n < 800 THEN '400-799' ELSE '800+' END AS bucket, count(*) AS n FROM (SELECT {COUNT.format('text')} AS n FROM documents) GROUP BY 1",
    "source_name_pretty": "SELECT page_id, upper(t[:1]) || t[2:] AS title FROM (SELECT page_id, array_to_string(list_transform(list_filter(string_split(translate(regexp_replace(string_split(url, '/')[-1], '(?i)\\.pdf$', ''), '-_', '  '), ' '), lambda w: w <> ''), lambda w: CASE WHEN lower(w) IN " + _IN(T.SMALL_WORDS) + " THEN lower(w) ELSE upper(w[:1]) || lower(w[2:]) END), ' ') AS t FROM pages)",
    "heading_features": f"SELECT doc_id, round({_UPPER.format('heading')}, 6)::DOUBLE AS upper_ratio, {_TITLE.format('heading')}::BIGINT AS title_words, {COUNT.format('heading')}::BIGINT AS words, (h <> '' AND (h LIKE '#%' OR ({COUNT.format('h')} <= 12 AND NOT regexp_matches(h, '[.!?]\\z') AND ({_UPPER.format('h')} >= 0.6 OR {_TITLE.format('h')} >= greatest(2, {COUNT.format('h')} - 1))))) AS heading_like FROM (SELECT *, replace({_FLAT.format('heading')}, ' .', '.') AS h FROM {FIRSTS})",
    "match_keys": r"SELECT norm, count(*) AS n FROM (SELECT " + STRIP.format(r"regexp_replace(regexp_replace(translate(lower(line), '–—»', '-- '), '[^\p{L}\p{M}\p{N}_\s/-]', ' ', 'g'), '\s+', ' ', 'g')") + f" AS norm FROM {LINES}) GROUP BY norm",
    "line_flags": f"SELECT source, count(*) AS lines, {', '.join(f'count(*) FILTER (WHERE {v}) AS {k}' for k, v in _FLAGS.items())} FROM (SELECT *, {STRIP.format('line')} AS b, {_FLAT.format('line')} AS f, {COUNT.format('line')} AS n FROM {LINES}) GROUP BY source",
    "start_flags": f"SELECT source, count(*) FILTER (WHERE low) AS lower_start, count(*) FILTER (WHERE tr) AS transition, count(*) FILTER (WHERE pr) AS pronoun, count(*) FILTER (WHERE trim(line) = '' OR tr OR low OR (pr AND n <= 12)) AS awkward, count(*) FILTER (WHERE n <= 5 AND (trim(line) = '' OR regexp_matches(trim(line), '\\A[a-z][a-z,\\s-]*[.,;:!?]?\\z'))) AS orphan FROM (SELECT source, line, {COUNT.format('line')} AS n, regexp_matches(regexp_replace(line, '\\A[(\"“]+', ''), '\\A\\p{{Ll}}') AS low, {_FIRST} IN {OPENERS} AS tr, {_FIRST} IN {LIGHT} AS pr FROM {LINES}) GROUP BY source",
    "search_texts": f"SELECT f.doc_id, md5(content || ' ' || heading) AS content_md5, md5(concat_ws(' ', {_PART('heading')}, source, lang, {_PART('content')})) AS all_md5, md5(concat_ws(' > ', source, lang, {_PART('heading')}) || '. ' || content) AS path_md5, md5(concat_ws(chr(10), {_PART('heading')}, source, lang, {_PART('content')})) AS lines_md5, md5(heading || '. ' || content) AS titled_md5 FROM {FIRSTS} f JOIN documents d USING (doc_id)",
    "vignette_flag": "SELECT item_id, len(text) > 250 OR contains(lower(text), 'year-old') AS vignette, len(text) AS chars FROM benchmark",
    "metadata_filter": "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source IS NOT DISTINCT FROM 'src1' AND contains(lower(text), 'the')",
    "suspicious_merges": f"SELECT source, sum(len(regexp_extract_all(text, '[a-z] (?:{'|'.join(T.SENTENCE_STARTS)})\\b')))::BIGINT AS merges FROM documents GROUP BY source",
}
_SHORT = "CASE w WHEN 'th' THEN 'thorium' WHEN 'nt' THEN 'notation'"
SQL["optimized_queries"] = f"""WITH a AS (SELECT item_id, {_FLAT.format('lower(text)')} AS low FROM benchmark),
    b AS (SELECT *, string_split(low, ' ') AS words, list_transform(string_split(low, ' '), lambda w: CASE WHEN w = 'teh' THEN 'the' ELSE w END) AS fixed FROM a),
    c AS (SELECT *, list_transform(fixed, lambda w: {_SHORT} ELSE w END) AS long, list_filter(list_transform(fixed, lambda w: {_SHORT} END), lambda x: x IS NOT NULL) AS meant FROM b),
    d AS (SELECT *, flatten(list_transform(long, lambda w: CASE WHEN w = 'the' THEN ['article', 'determiner'] ELSE []::VARCHAR[] END)) AS added FROM c),
    e AS (SELECT *, list_concat(meant, added) AS t FROM d)
    SELECT item_id, CASE WHEN low = '' THEN '' WHEN low = 'to be' THEN 'existence' ELSE {STRIP.format("array_to_string(list_concat(long, added), ' ')")} END AS optimized,
        array_to_string(CASE WHEN low = '' THEN [] WHEN low = 'to be' THEN ['existence'] ELSE list_filter(t, lambda x, i: list_position(t, x) = i)[:8] END, '|') AS terms,
        CASE WHEN low = '' THEN 0.5 WHEN low = 'to be' THEN 0.96 WHEN list_contains(words, 'teh') THEN 0.82 ELSE 0.88 END::DOUBLE AS confidence, contains(low, 'stroke') AS emergency FROM e"""

QUERIES = {f.__name__: f for f in (tokens_plain, tokens_stemmed, tokens_longer, content_terms, clean_ocr_ws, strip_citations, ligature_fix, word_stats_histogram, source_name_pretty, heading_features, match_keys, line_flags, start_flags, search_texts, vignette_flag, metadata_filter, suspicious_merges, optimized_queries)}
