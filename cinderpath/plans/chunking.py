"""Queries over documents that are framed as Markdown: elements, sections, packed chunks, sentences, recursive pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..session import table
from .registry import query

#: SQL that Spark and DuckDB both read; {nl} is a line end.
_MARKED = (
    "concat('# Report ', doc_id, {nl}, {nl}, text, {nl}, '## Source ', source, {nl}, '> said of ', lang, {nl}, '> twice', {nl}, '```py', {nl}, '# code of ', doc_id, {nl}, {nl}, 'x = 1', {nl}, '```', {nl}, "
    "'```', {nl}, 'y', {nl}, '```', {nl}, '### Table', {nl}, '|a|b|', {nl}, '|-|-|', {nl}, '|1|2|', {nl}, '# Last part', {nl}, {nl}, 'The end.')"
)


def _marked(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_MARKED.format(nl='char(10)')} AS text")


_ELEMENTS = (
    f"WITH d AS (SELECT doc_id, {_MARKED.format(nl='chr(10)')} AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM d WHERE text IS NOT NULL), "
    "f AS (SELECT *, coalesce(sum(CAST(starts_with(s, '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fences FROM l), "
    "k AS (SELECT *, CASE WHEN starts_with(s, '```') OR fences % 2 = 1 THEN 'code_block' WHEN regexp_matches(s, '^#{1,6}\\s+\\S') THEN 'heading' WHEN regexp_matches(s, '^\\|.+\\|$') THEN 'table' WHEN regexp_matches(s, '^>\\s*\\S') THEN 'quote' WHEN trim(s) = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM f), "
    "o AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS was FROM k), "
    "p AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> kind OR kind = 'heading' OR kind = 'code_block' AND starts_with(s, '```') AND fences % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS part FROM o), "
    "g AS (SELECT doc_id, part, kind, string_agg(s, chr(10) ORDER BY line) AS text FROM p WHERE kind <> 'blank' GROUP BY doc_id, part, kind), "
    "e AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) AS INT) AS element, kind, CAST(CASE WHEN kind = 'heading' THEN length(regexp_extract(text, '^(#+)', 1)) ELSE 0 END AS INT) AS level, "
    "CASE WHEN kind = 'heading' THEN trim(regexp_extract(text, '^#+\\s+(.+)$', 1)) END AS title, CASE WHEN kind = 'code_block' THEN regexp_extract(text, '^```(\\w*)', 1) END AS language, text FROM g) "
)
#: A heading is open at an element if no heading of its level or above lies between: by comparing headings with each other.
_SECTIONS = (
    _ELEMENTS + ", h AS (SELECT doc_id, element, level, title FROM e WHERE kind = 'heading'), n AS (SELECT a.doc_id, a.element, a.level, a.title, min(b.element) AS ends FROM h a LEFT JOIN h b ON b.doc_id = a.doc_id AND b.element > a.element AND b.level <= a.level GROUP BY ALL), "
    "c AS (SELECT e.*, (SELECT string_agg(n.title, ' > ' ORDER BY n.element) FROM n WHERE n.doc_id = e.doc_id AND n.element <= e.element AND (n.ends IS NULL OR n.ends > e.element)) AS section FROM e) "
)


@query(_ELEMENTS + "SELECT doc_id, element, kind, level, title, language, sha256(text) AS digest FROM e")
def document_elements(spark, sf_dir):
    return C.elements(_marked(spark, sf_dir)).withColumn("digest", F.sha2("text", 256)).drop("text")


@query(_SECTIONS + "SELECT doc_id, element, coalesce(section, '') AS section FROM c")
def section_titles(spark, sf_dir):
    return C.sections(C.elements(_marked(spark, sf_dir))).select("doc_id", "element", "section")


@query(
    _SECTIONS.replace("WITH ", "WITH RECURSIVE ", 1) + ", w(doc_id, element, chunk, size, alone) AS (SELECT doc_id, 1, 1, length(text), kind IN ('code_block', 'table') FROM e WHERE element = 1 UNION ALL "
    "SELECT e.doc_id, e.element, CASE WHEN z THEN chunk + 1 ELSE chunk END, CASE WHEN z THEN length(text) ELSE size + length(text) END, e.kind IN ('code_block', 'table') FROM "
    "(SELECT w.*, w.size + length(x.text) > 1500 OR w.alone OR x.kind IN ('code_block', 'table', 'heading') AS z FROM w JOIN e x ON x.doc_id = w.doc_id AND x.element = w.element + 1) v JOIN e ON e.doc_id = v.doc_id AND e.element = v.element + 1), "
    "j AS (SELECT c.*, chunk FROM c JOIN w ON w.doc_id = c.doc_id AND w.element = c.element) SELECT doc_id, chunk, CASE WHEN count(*) = 1 THEN min(kind) ELSE 'mixed' END AS kind, coalesce(arg_min(section, element), '') AS section, "
    "bool_or(kind = 'code_block') AS has_code, bool_or(kind = 'table') AS has_table, sha256(string_agg(text, concat(chr(10), chr(10)) ORDER BY element)) AS digest FROM j GROUP BY doc_id, chunk"
)
def structured_chunks(spark, sf_dir):
    return C.packed(C.elements(_marked(spark, sf_dir))).withColumn("digest", F.sha2("text", 256)).drop("text")


@query(
    "WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z가-힣])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS x FROM documents) "
    "SELECT doc_id, CAST(generate_subscripts(x, 1) - 1 AS INT) AS sentence, sha256(unnest(x)) AS digest FROM s"
)
def document_sentences(spark, sf_dir):
    return C.sentences(table(spark, sf_dir, "documents")).select("doc_id", "sentence", F.sha2("text", 256).alias("digest"))


@query()
def recursive_chunks(spark, sf_dir):
    """Without SQL; a test holds the pieces against the texts."""
    return C.recursive_chunks(table(spark, sf_dir, "documents"))
