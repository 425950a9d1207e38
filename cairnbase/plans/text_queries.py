"""Queries over texts and pages, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entities, ranking, structure
from ..session import table
from ..sources.files import html_headings, html_links

SEARCH = 'thing "of the" ereand'
PHRASE = '"of the" "in the"'
NEEDLE = "thing"

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CHUNKS = rf"""
chunks AS (
  SELECT doc_id, i AS ord, {_STRIP.format("substring(s, CAST(i * 1300 + 1 AS BIGINT), 1500)")} AS text
  FROM (SELECT doc_id, s, unnest(generate_series(0, CASE WHEN length(s) <= 1500 THEN 0 ELSE (length(s) - 1) // 1300 END)) AS i
        FROM (SELECT doc_id, {_STRIP.format("text")} AS s FROM documents))
  WHERE length({_STRIP.format("substring(s, CAST(i * 1300 + 1 AS BIGINT), 1500)")}) > 0
)"""
_LINES = r"regexp_split_to_array({}, '\r\n|\n|\r')"
_FULL = rf"list_filter({_LINES.format('text')}, lambda x: length({_STRIP.format('x')}) > 0)"
_TOC = rf"(len({_FULL}) >= 4 AND len(list_filter({_FULL}, lambda x: regexp_matches(x, '\.{{4,}}\s*\d*\s*$'))) >= 0.3 * len({_FULL}))"
_FURN = rf"list_filter(list_transform({_LINES.format('text')}, lambda x: {_STRIP.format('x')}), lambda x: length(x) >= 3)"
_BOIL = rf"(len({_FURN}) BETWEEN 1 AND 4 AND len(list_filter({_FURN}, lambda x: NOT regexp_matches(x, '(?i)^\s*(version date:\s*[\d-]+|bluetooth sig proprietary|page\s+\d+|bluetooth core specification\b.*)\s*$'))) = 0)"


def _documents_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chunk_pages(table(spark, sf_dir, "documents"), "doc_id")


def chunk_split(spark, sf_dir):
    return _documents_chunks(spark, sf_dir)


def keyword_search(spark, sf_dir):
    hits = ranking.keyword_search(_documents_chunks(spark, sf_dir), SEARCH, key=("doc_id", "ord"))
    return hits.select("rank", "doc_id", "ord", "score", "phrase_hits", "word_hits", "occurrences")


def keyword_phrase(spark, sf_dir):
    hits = ranking.keyword_search(table(spark, sf_dir, "documents"), PHRASE, k=20, key=("doc_id",))
    return hits.select("rank", "doc_id", "score", "phrase_hits", "occurrences")


def _keyword_sql(source: str, key: list[str], phrases: list[str], words: list[str], k: int, columns: str) -> str:
    n = len(phrases) + len(words)
    low = "lower(text)"
    hit = lambda ns: " + ".join(f"CAST(contains({low}, '{x}') AS INT)" for x in ns) or "0"
    occ = " + ".join(f"(length({low}) - length(replace({low}, '{x}', ''))) // {len(x)}" for x in phrases + words)
    order = f"phrase_hits DESC, word_hits DESC, occurrences DESC, length(text), {', '.join(key)}"
    return f"""SELECT row_number() OVER (ORDER BY {order}) AS rank, {columns} FROM (
      SELECT *, {hit(phrases)} AS phrase_hits, {hit(words)} AS word_hits, {occ} AS occurrences, round(({hit(phrases)} + {hit(words)}) / {n}, 4) AS score
      FROM {source} WHERE ({" OR ".join(f"contains({low}, '{x}')" for x in phrases + words)}) AND NOT {_TOC} AND NOT {_BOIL})
    ORDER BY {order} LIMIT {k}"""


def noise_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.is_contents_noise(F.col("text")).alias("contents"), T.is_boilerplate(F.col("text")).alias("boilerplate"), T.is_noise(F.col("text")).alias("noise"))


def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.terms(F.col("text"))), " ").alias("terms"))


def like_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.like_escape(F.col("url")).alias("escaped"))


def norm_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    forms = p.select(F.concat(F.lit("The "), F.regexp_replace("p_name", " ", "_")).alias("surface")).union(p.select(F.concat("p_type", F.lit(" Procedure."))))
    return forms.distinct().select("surface", T.norm_key(F.col("surface")).alias("norm_key"), T.merge_key(F.lower("surface")).alias("merge_key"))


def slugs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return p.select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_brand"), 20).alias("slug"), T.entity_slug(F.col("p_partkey"), F.lower("p_name")).alias("entity_slug"), T.disambiguator(F.col("p_name")).alias("disc"))


def pageworthy(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    forms = p.select(F.col("p_name").alias("name"))
    for c in (F.concat(F.col("p_size").cast("string"), F.lit(" ms")), F.concat(F.lit("Table "), F.col("p_size").cast("string")), F.col("p_brand"), F.hex("p_partkey"), F.concat(F.lit("T_ID "), F.col("p_size").cast("string")), F.concat(F.lit("0x"), F.hex("p_partkey"))):
        forms = forms.union(p.select(c))
    return forms.distinct().select("name", T.is_pageworthy(F.col("name")).alias("worthy"))


def row_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    named = p.select("p_partkey", F.concat(F.lit("T_ID "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" - "), F.col("p_name"))).otherwise("")).alias("surface"))
    return named.select("p_partkey", T.strip_row_label(F.col("surface")).alias("clean"))


def acronym_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pair = T.acronym_pair(F.concat("p_name", F.lit(" ("), F.upper(F.substring("p_type", 1, 3)), F.lit(")")))
    return p.select("p_partkey", pair["expansion"].alias("expansion"), pair["acronym"].alias("acronym"))


def display_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.canonical_display_name(F.array("p_name", F.regexp_replace("p_name", " ", "_"))).alias("display"))


def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.human_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


def kwic(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.lower("text").contains(NEEDLE))
    return d.select("doc_id", T.keyword_in_context(F.col("text"), NEEDLE).alias("snippet"))


def evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.evidence_window(F.col("text"), F.array(F.lit("thing"), F.lit("shere"))).alias("evidence"))


def href_links(spark, sf_dir):
    return html_links(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"), F.max("href").alias("last_href"))


def page_headings(spark, sf_dir):
    return html_headings(table(spark, sf_dir, "pages")).select("page_id", "ord", "level", F.length("title").alias("title_chars"))


def orphan_links(spark, sf_dir):
    """Link targets that no page has as the last part of its URL's path."""
    pages = table(spark, sf_dir, "pages")
    stems = pages.select(F.concat(F.lit("/"), F.regexp_extract("url", r"/([^/?#]+)/?(?:[?#].*)?$", 1)).alias("stem")).distinct()
    return html_links(pages).select("href").join(stems, F.col("href") == F.col("stem"), "left_anti").groupBy("href").agg(F.count("*").alias("n"))


def _paragraphs(spark, sf_dir):
    """An outline for each document: its lines as entries, the level by their length."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return d.select("file_id", "ord", (F.length("line") % 3 + 1).alias("level"), (F.col("ord") + 1).alias("page"), F.lit(100_000).alias("total_pages"))


def outline_tree(spark, sf_dir):
    return structure.section_bounds(_paragraphs(spark, sf_dir)).select("file_id", "ord", "level", "parent_ord", "page_end")


def outline_tops(spark, sf_dir):
    rows = structure.section_bounds(_paragraphs(spark, sf_dir))
    key = lambda c: F.col("file_id") * 100_000 + F.col(c)
    tops = structure.top_level(rows.select(key("ord").alias("id"), key("parent_ord").alias("parent_id")))
    return tops.groupBy("top_id").agg(F.count("*").alias("n"))


def windows_of_chunks(spark, sf_dir):
    chunks = _documents_chunks(spark, sf_dir).withColumnRenamed("doc_id", "file_id")
    w = structure.passages(structure.extraction_windows(chunks, 3), 100)
    return w.select("file_id", "window", "passage")


def even_sample(spark, sf_dir):
    chunks = _documents_chunks(spark, sf_dir)
    return structure.even_sample(chunks, 3, "doc_id", "ord").select("doc_id", "ord")


def contains_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("name"), F.lit(None).cast("array<string>").alias("aliases"))
    return entities.contains_join(d, b)


def content_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_KEY_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(surface), '[\s_]+', ' ', 'g'),
  '^[ \t\n\r"''`.,:;()\[\]{}]+|[ \t\n\r"''`.,:;()\[\]{}]+$', '', 'g'), '^((the|a|an) )+(.)', '\3'), '(.)( (procedure|process|mechanism|feature|function|method))+$', '\1')"""
_LABEL = r"'(?i)^t[_\- ]?id\s*[#:]?\s*\d+\s*(?:[-–—:]\s*)?'"
_UNITS = T.UNITS
_OUTLINE = """
lines AS (SELECT file_id, ord, length(line) % 3 + 1 AS level, ord + 1 AS page FROM (
  SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents)),
tree AS (SELECT a.file_id, a.ord, a.level, a.page,
  (SELECT max(b.ord) FROM lines b WHERE b.file_id = a.file_id AND b.ord < a.ord AND b.level < a.level) AS parent_ord,
  (SELECT min(b.ord) FROM lines b WHERE b.file_id = a.file_id AND b.ord > a.ord AND b.level <= a.level) AS next_ord FROM lines a)"""

QUERIES = {
    f.__name__: f
    for f in (
        chunk_split, keyword_search, keyword_phrase, noise_filter, query_terms, like_escape, norm_keys, slugs, pageworthy, row_labels, acronym_pairs, display_names,
        human_sizes, kwic, evidence, href_links, page_headings, orphan_links, outline_tree, outline_tops, windows_of_chunks, even_sample, contains_join, content_dedupe,
    )
}

ORACLES = {
    "chunk_split": f"WITH {_CHUNKS} SELECT doc_id, CAST(ord AS INT) AS ord, text FROM chunks",
    "keyword_search": f"WITH {_CHUNKS} " + _keyword_sql("chunks", ["doc_id", "ord"], ["of the"], ["thing", "ereand"], 8, "doc_id, ord, score, phrase_hits, word_hits, occurrences"),
    "keyword_phrase": _keyword_sql("documents", ["doc_id"], ["of the", "in the"], [], 20, "doc_id, score, phrase_hits, occurrences"),
    "noise_filter": f"SELECT doc_id, {_TOC} AS contents, {_BOIL} AS boilerplate, {_TOC} OR {_BOIL} AS noise FROM documents",
    "query_terms": r"SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.\-][a-z0-9]+)*'))), ' ') AS terms FROM benchmark",
    "like_escape": r"SELECT page_id, replace(replace(replace(url, '\', '\\'), '%', '\%'), '_', '\_') AS escaped FROM pages",
    "norm_keys": rf"SELECT surface, {_KEY_SQL} AS norm_key, trim(regexp_replace(lower(surface), '[\s_]+', ' ', 'g')) AS merge_key FROM (SELECT DISTINCT 'The ' || replace(p_name, ' ', '_') AS surface FROM part UNION SELECT DISTINCT p_type || ' Procedure.' FROM part)",
    "slugs": r"""SELECT p_partkey, regexp_replace(substring(trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 1, 20), '-+$', '') AS slug,
        trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS entity_slug, substring(sha256(p_name), 1, 6) AS disc FROM part""",
    "pageworthy": rf"""WITH names AS (SELECT DISTINCT unnest([p_name, p_size || ' ms', 'Table ' || p_size, p_brand, hex(p_partkey), 'T_ID ' || p_size, '0x' || hex(p_partkey)]) AS name FROM part)
        SELECT name, CASE WHEN NOT regexp_matches(name, '\pL') THEN false WHEN regexp_matches(name, '^[0-9]+([.,][0-9]+)*$') OR regexp_matches(name, '^0x[0-9A-Fa-f]+$') THEN false
        WHEN regexp_matches(name, '(?i)^[0-9][0-9.,]*\s*({_UNITS})$') OR regexp_matches(name, '{T.DOC_REFERENCE}') THEN false
        WHEN regexp_replace(name, {_LABEL}, '') = '' THEN false WHEN regexp_matches(name, '^[A-Z][A-Z0-9]+$') OR regexp_matches(name, '^[A-Za-z][0-9]$') THEN true
        WHEN regexp_matches(name, '^[0-9A-Fa-f]{{4,}}$') AND regexp_matches(name, '[0-9]') THEN false WHEN length(name) < 3 THEN false ELSE true END AS worthy FROM names""",
    "row_labels": f"SELECT p_partkey, trim(regexp_replace('T_ID ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ' - ' || p_name ELSE '' END, {_LABEL}, '')) AS clean FROM part",
    "acronym_pairs": f"SELECT p_partkey, {_KEY_SQL} AS expansion, lower(substring(p_type, 1, 3)) AS acronym FROM (SELECT *, p_name AS surface FROM part)",
    "display_names": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN w = lower(w) THEN upper(w[1:1]) || w[2:] ELSE w END), ' ') AS display FROM part",
    "human_sizes": """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size
        FROM (SELECT doc_id, n_chars * n_chars AS n FROM documents)""",
    "kwic": f"SELECT doc_id, substring(text, greatest(instr(lower(text), '{NEEDLE}') - 48, 1), 280) AS snippet FROM documents WHERE contains(lower(text), '{NEEDLE}')",
    "evidence": rf"""WITH p AS (SELECT doc_id, text, coalesce(list_min(list_filter([instr(lower(text), 'thing'), instr(lower(text), 'shere')], lambda x: x > 0)) - 1, 0) AS spot FROM documents),
        q AS (SELECT *, greatest(spot - 260, 0) AS a, least(spot + 260, length(text)) AS b FROM p)
        SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || {_STRIP.format("substring(text, a + 1, b - a)")} || CASE WHEN b < length(text) THEN '…' ELSE '' END AS evidence FROM q""",
    "href_links": """SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets, max(href) AS last_href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""",
    "page_headings": r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h([1-6])[^>]*>.*?</h[1-6]>')) AS h, generate_subscripts(regexp_extract_all(html, '(?s)<h([1-6])[^>]*>.*?</h[1-6]>'), 1) - 1 AS ord FROM pages)
        SELECT page_id, CAST(ord AS INT) AS ord, CAST(regexp_extract(h, '^<h([1-6])', 1) AS INT) AS level, CAST(length(trim(regexp_replace(h, '(?s)<[^>]*>', '', 'g'), ' ')) AS INT) AS title_chars FROM h""",
    "orphan_links": r"""WITH l AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages), s AS (SELECT DISTINCT '/' || regexp_extract(url, '/([^/?#]+)/?(?:[?#].*)?$', 1) AS stem FROM pages)
        SELECT href, count(*) AS n FROM l WHERE href NOT IN (SELECT stem FROM s) GROUP BY href""",
    "outline_tree": f"WITH {_OUTLINE} SELECT file_id, CAST(ord AS INT) AS ord, CAST(level AS INT) AS level, CAST(parent_ord AS INT) AS parent_ord, CAST(CASE WHEN next_ord IS NULL THEN 100000 ELSE greatest(page, next_ord) END AS INT) AS page_end FROM tree",
    "outline_tops": f"WITH RECURSIVE {_OUTLINE}, up AS (SELECT file_id, ord, ord AS top FROM tree WHERE parent_ord IS NULL UNION ALL SELECT t.file_id, t.ord, up.top FROM tree t JOIN up ON t.file_id = up.file_id AND t.parent_ord = up.ord) SELECT file_id * 100000 + top AS top_id, count(*) AS n FROM up GROUP BY 1",
    "windows_of_chunks": f"""WITH {_CHUNKS}, m AS (SELECT *, ({_TOC} OR {_BOIL}) AS noise FROM chunks), r AS (SELECT *, max(CAST(NOT noise AS INT)) OVER (PARTITION BY doc_id) AS any_real FROM m),
        k AS (SELECT doc_id, ord, text, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) // 3 AS win FROM r WHERE NOT noise OR any_real = 0)
        SELECT doc_id AS file_id, CAST(win AS INT) AS window, string_agg(substring(text, 1, 100), chr(10) || chr(10) ORDER BY ord) AS passage FROM k GROUP BY doc_id, win""",
    "even_sample": f"""WITH {_CHUNKS}, p AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks)
        SELECT doc_id, CAST(ord AS INT) AS ord FROM p WHERE n <= 3 OR i IN (0, n // 3, 2 * n // 3)""",
    "contains_join": """SELECT candidate_id, chunk_id FROM (SELECT item_id AS candidate_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rn FROM benchmark b, documents d WHERE contains(lower(d.text), lower(b.text))) WHERE rn <= 25""",
    "content_dedupe": "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
}
