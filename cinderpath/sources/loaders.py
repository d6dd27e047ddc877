"""Document loaders: files become rows of doc_id, content, source, with Spark's own readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Loader = Callable[[SparkSession, str], DataFrame]

LOADERS: dict[str, Loader] = {}


def loader(*extensions: str) -> Callable[[Loader], Loader]:
    """Register a loader for file name extensions; users may add their own."""

    def add(f: Loader) -> Loader:
        LOADERS.update(dict.fromkeys(extensions, f))
        return f

    return add


def load(spark: SparkSession, path: str) -> DataFrame:
    """Load by the path's extension, lower-cased."""
    extension = path.rsplit(".", 1)[-1].lower()
    if extension not in LOADERS:
        raise ValueError(f"no loader for .{extension}; there are {', '.join(sorted(LOADERS))}")
    return LOADERS[extension](spark, path)


def _id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def _documents(rows: DataFrame, content: Column) -> DataFrame:
    """Non-blank contents, with an id from the file's name and the content."""
    out = rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), content.alias("content"))
    return out.where(F.length(F.trim("content")) > 0).select(_id(F.col("source"), F.col("content")).alias("doc_id"), "content", "source")


@loader("txt", "text")
def load_text(spark: SparkSession, path: str) -> DataFrame:
    """One document a file; empty files give none."""
    return _documents(spark.read.text(path, wholetext=True), F.col("value"))


@loader("csv")
def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """One document a row: `column: value` lines of the columns that aren't empty."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    lines = (F.when(F.length(F.trim(F.col(f"`{c}`"))) > 0, F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in rows.columns)
    return _documents(rows, F.concat_ws("\n", *lines))


def flatten(schema: T.StructType, prefix: str = "", dot: str = "") -> list[tuple[str, Column]]:
    """(name, text) of each scalar below a schema; lists of scalars are joined, other lists become JSON."""
    out = []
    for field in schema.fields:
        name, column = f"{dot}{field.name}", F.col(f"{prefix}`{field.name}`")
        if isinstance(field.dataType, T.StructType):
            out += flatten(field.dataType, f"{prefix}`{field.name}`.", f"{name}.")
        elif isinstance(field.dataType, T.ArrayType):
            simple = not isinstance(field.dataType.elementType, (T.StructType, T.ArrayType, T.MapType))
            out.append((name, F.array_join(column.cast("array<string>"), ", ") if simple else F.to_json(column)))
        else:
            out.append((name, column.cast("string")))
    return out


#: Keys whose text is a document's content, in this order.
TEXT_KEYS = ("text", "content", "body", "description", "abstract", "summary")


def _from_json(rows: DataFrame) -> DataFrame:
    rows = rows.drop("_corrupt_record")
    if not rows.columns:
        return rows.sparkSession.createDataFrame([], "doc_id string, content string, source string")
    flat = F.concat_ws("\n", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in flatten(rows.schema)))
    strings = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)}
    own = [F.when(F.length(F.trim(F.col(f"`{k}`"))) > 0, F.col(f"`{k}`")) for k in TEXT_KEYS if k in strings]
    return _documents(rows, F.coalesce(*own, flat))


@loader("json")
def load_json(spark: SparkSession, path: str) -> DataFrame:
    """One document an object; an array's items are documents of their own."""
    return _from_json(spark.read.json(path, multiLine=True))


@loader("jsonl", "ndjson")
def load_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document a line; malformed lines are dropped."""
    return _from_json(spark.read.json(path, mode="DROPMALFORMED"))


@loader("xml")
def load_xml(spark: SparkSession, path: str, row_tag: str = "row") -> DataFrame:
    """One document an element of the row tag, as its flattened attributes and texts."""
    return _from_json(spark.read.format("xml").option("rowTag", row_tag).load(path))


def html_text(html: Column | str) -> Column:
    """Text without scripts, styles, tags and entities, with single spaces."""
    x = F.col(html) if isinstance(html, str) else html
    x = F.regexp_replace(x, r"(?is)<script[^>]*>.*?</script>", "")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", "")
    x = F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"&[A-Za-z]+;", " ")
    return F.trim(F.regexp_replace(x, r"[ \t\n\f\r]+", " "))


@loader("html", "htm")
def load_html(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark.read.text(path, wholetext=True), html_text("value"))


def markdown_text(text: Column | str) -> Column:
    """Markdown without fenced and inline code."""
    x = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(x, r"(?s)```.*?```", ""), r"`[^`]+`", "")


def markdown_headings(text: Column | str) -> Column:
    """Headings as `hN: text`."""
    x = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(x, F.lit(r"(?m)^(#{1,6} +.+)$"), 1)
    return F.transform(found, lambda h: F.concat(F.lit("h"), F.length(F.regexp_extract(h, "^(#+)", 1)), F.lit(": "), F.trim(F.regexp_replace(h, "^#+", ""))))


def markdown_sections(documents: DataFrame, level: int = 2) -> DataFrame:
    """doc_id, pos, title, content of the sections under headings up to a level; what precedes them is `Introduction`."""
    parts = F.split("content", rf"(?m)^(?=#{{1,{level}}} )")
    rows = documents.select("doc_id", F.posexplode(parts).alias("pos", "part"))
    heading = F.regexp_extract("part", rf"^#{{1,{level}}} +(.+)", 1)
    rows = rows.select("doc_id", "pos", F.when(heading != "", F.trim(heading)).otherwise("Introduction").alias("title"), F.regexp_replace(F.regexp_replace("part", rf"^#{{1,{level}}} +.*\n?", ""), r"^\s+|\s+$", "").alias("content"))
    return rows.where("content != ''")


@loader("md", "markdown")
def load_markdown(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark.read.text(path, wholetext=True), markdown_text("value"))


@loader("parquet")
def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _from_json(spark.read.parquet(path))
