"""Chunking that follows a document's structure: elements, section titles, packed chunks, sentences and a recursive splitter."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Greatest and usual size of a chunk in characters; size, overlap and separators of the recursive splitter.
MOST, TARGET = 1500, 1000
SIZE, OVERLAP, SEPARATORS = 1000, 200, ("\n\n", "\n", ". ", " ", "")


def elements(documents: DataFrame) -> DataFrame:
    """doc_id, element, kind, level, title, language, text of each part of a Markdown text, in order.

    Kinds: heading, code_block (between fences), table, quote, paragraph (lines up to a blank one). Lines are told apart one by
    one and put together by running counts within their document; empty parts are left out, null texts have none.
    """
    lines = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    upto = Window.partitionBy("doc_id").orderBy("line")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    fence = F.col("s").startswith("```")
    lines = lines.withColumn("fences", F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)))
    code = fence | (F.col("fences") % 2 == 1)
    heading = F.col("s").rlike(r"^#{1,6}\s+\S")
    kind = F.when(code, "code_block").when(heading, "heading").when(F.col("s").rlike(r"^\|.+\|$"), "table").when(F.col("s").rlike(r"^>\s*\S"), "quote").when(F.trim("s") == "", "blank").otherwise("paragraph")
    lines = lines.withColumn("kind", kind).withColumn("was", F.lag("kind").over(upto))
    opens = F.col("was").isNull() | (F.col("was") != F.col("kind")) | (F.col("kind") == "heading") | ((F.col("kind") == "code_block") & fence & (F.col("fences") % 2 == 0))
    lines = lines.withColumn("part", F.sum(opens.cast("int")).over(upto)).where("kind != 'blank'")
    # A part is a piece of one document's text.
    parts = lines.groupBy("doc_id", "part", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "s"))), lambda x: x["s"]), "\n").alias("text"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("text", "^(#+)", 1))).otherwise(0)
    title = F.when(F.col("kind") == "heading", F.trim(F.regexp_extract("text", r"^#+\s+(.+)$", 1)))
    language = F.when(F.col("kind") == "code_block", F.regexp_extract("text", r"^```(\w*)", 1))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("part"))
    return parts.select("doc_id", number.alias("element"), "kind", level.alias("level"), title.alias("title"), language.alias("language"), "text")


def sections(parts: DataFrame) -> DataFrame:
    """The elements with `section`, the titles of the headings open at each, outermost first and joined by ' > '.

    A heading is open until one of its own level or above; of each level the last heading counts if none above came after it.
    """
    upto = Window.partitionBy("doc_id").orderBy("element")
    last = {n: F.max(F.when(F.col("level") == n, F.struct("element", "title"))).over(upto) for n in range(1, 7)}
    rows = parts.select("*", *(last[n].alias(f"_h{n}") for n in last))
    open_, above = [], F.lit(0)
    for n in last:
        at = F.coalesce(F.col(f"_h{n}.element"), F.lit(0))
        open_.append(F.when(at > above, F.col(f"_h{n}.title")))
        above = F.greatest(above, at)
    return rows.select(*parts.columns, F.concat_ws(" > ", *open_).alias("section"))


def packed(parts: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, chunk, kind (mixed for several elements), section (of the first), has_code, has_table, text of chunks.

    Code blocks and tables stand alone, a heading opens a chunk, other elements are added while a chunk stays within `most`;
    a larger element is a chunk by itself. The fold runs over one document's elements.
    """
    alone = F.col("kind").isin("code_block", "table")
    rows = parts.select("doc_id", F.struct("element", alone.alias("alone"), (F.col("kind") == "heading").alias("heading"), F.length("text").alias("size")).alias("e"))

    def step(state, e):
        full = (state["size"] + e["size"] > most) | e["alone"] | state["alone"] | e["heading"]
        new = F.when(full | (state["chunk"] == 0), state["chunk"] + 1).otherwise(state["chunk"])
        size = F.when(new == state["chunk"], state["size"] + e["size"]).otherwise(e["size"])
        return F.struct(new.alias("chunk"), size.alias("size"), e["alone"].alias("alone"), F.concat(state["out"], F.array(F.struct(e["element"].alias("element"), new.alias("chunk")))).alias("out"))

    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("size"), F.lit(False).alias("alone"), F.array().cast("array<struct<element:int,chunk:int>>").alias("out"))
    dealt = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("es")).select("doc_id", F.explode(F.aggregate("es", start, step)["out"]).alias("o")).select("doc_id", "o.element", "o.chunk")
    joined = sections(parts).join(dealt, ["doc_id", "element"])
    return joined.groupBy("doc_id", "chunk").agg(
        F.when(F.count("*") == 1, F.min("kind")).otherwise("mixed").alias("kind"), F.min_by("section", "element").alias("section"),
        F.bool_or(F.col("kind") == "code_block").alias("has_code"), F.bool_or(F.col("kind") == "table").alias("has_table"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element", "text"))), lambda x: x["text"]), "\n\n").alias("text"),
    )


def sentences(documents: DataFrame) -> DataFrame:
    """doc_id, sentence, text: texts cut after a full stop, exclamation or question mark before a capital or Hangul letter."""
    each = F.posexplode(F.split("text", r"(?<=[.!?])\s+(?=[A-Z가-힣])"))
    return documents.select("doc_id", each.alias("sentence", "text"))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the first separator that a text has and, where a part is still too long, at the
    next ones; neighbouring parts are joined while they fit, and a piece begins with the last parts of the one before, up to `overlap`."""
    cut = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(cut) + 1 :] or ("",)
    parts = [text[i : i + size] for i in range(0, len(text), max(1, size - overlap))] if cut == "" else [p + cut for p in text.split(cut)]
    if cut == "":
        return [p for p in parts if p.strip()]
    parts[-1] = parts[-1][: len(parts[-1]) - len(cut)]
    out: list[str] = []
    held: list[str] = []
    for part in parts:
        if len(part.rstrip()) > size:
            if held:
                out.append("".join(held))
                held = []
            out += split_text(part, size, overlap, rest)
            continue
        if held and sum(map(len, held)) + len(part.rstrip()) > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part.rstrip()) > size):
                held.pop(0)
        held.append(part)
    if held:
        out.append("".join(held))
    return [p.strip() for p in out if p.strip()]


def recursive_chunks(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk, text of every document's pieces (see split_text); blank and null texts have none."""

    def run(batches):
        for batch in batches:
            ids, numbers, texts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, piece in enumerate(split_text(text or "", size, overlap)):
                    ids.append(doc)
                    numbers.append(n)
                    texts.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "chunk", "text"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, chunk int, text string")
