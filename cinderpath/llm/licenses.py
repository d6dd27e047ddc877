"""License scan with DataFrame functions only: MinHash bands of text windows retrieve templates, containment verifies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, tune

#: Words of a shingle, least containment, and bands (of one minimum each). A window is twice as long as its
#: template and starts at each multiple of its length, so every full copy lies in one; then the similarity is
#: 0.36 at least (0.5 for a verbatim copy) and the chance that no band meets 0.64 ** 20, about 0.0001 (1e-6).
SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 20
#: Templates of one pass over the documents; more are scanned in blocks of so many.
BLOCK_TEMPLATES = 500

#: Customary license notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0-text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def _words(text):
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words, k: int):
    """Hashes of k neighbouring words at each place; of fewer words, of all of them as one."""
    at = F.sequence(F.lit(1), F.size(words) - (k - 1))
    each = F.transform(at, lambda i: F.xxhash64(*(F.element_at(words, (i + j).cast("int")) for j in range(k))))
    return F.when(F.size(words) >= k, each).when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def _minimum(shingles, band: int):
    """The shingle with the least hash of a band's hash function."""
    return F.array_min(F.transform(shingles, lambda x: F.struct(F.xxhash64(x, F.lit(band)).alias("h"), x.alias("x"))))["x"]


def scan(documents: DataFrame, notices: DataFrame, k: int = SHINGLE, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_TEMPLATES) -> DataFrame:
    """doc_id, n_licenses, licenses (names, sorted, comma-joined), containment (the greatest) for every document.

    Words are runs of ASCII letters and digits in lower case. A window can share a band with a template only
    if it holds that band's minimum of the template, so signatures are computed for windows around such
    shingles alone; windows that meet a template in a band are verified by the share of its shingles they hold.
    All of it happens within a document's row; only matches are shuffled.

    Templates without words match nothing; repeated names count as one license. Null and empty texts have
    no license and containment 0. Rows with a null id are dropped, repeated ids make one row. Other columns
    are ignored. An empty table gives an empty result.
    """
    tune(documents.sparkSession)
    marks = notices.select("license", F.array_distinct(_shingles(_words(F.col("text")), k)).alias("t")).where(F.size("t") > 0)
    marks = save(marks.select("license", "t", F.size("t").alias("n"), *(_minimum(F.col("t"), b).alias(f"m{b}") for b in range(BANDS))))
    docs = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    blocks = -(-marks.count() // block)
    for i in range(blocks):
        minima = marks.where(F.pmod(F.xxhash64("license"), F.lit(blocks)) == i).select("license", "t", "n", F.array(*(f"m{b}" for b in range(BANDS))).alias("m"))
        known = [r[0] for r in minima.select(F.explode("m")).distinct().collect()]  # at most block * BANDS numbers
        words = docs.select("doc_id", _words(F.col("text")).alias("words"))
        rows = words.select("doc_id", _shingles(F.col("words"), k).alias("s"))
        rows = rows.select("doc_id", "s", F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda j: (F.size("s") > 0) & F.get("s", j).isin(known)).alias("at"))
        hits = rows.select("doc_id", "s", F.explode_outer("at").alias("at")).where("at is not null")
        each = minima.select("license", "t", "n", "m", F.explode(F.array_distinct("m")).alias("x"))
        near = hits.withColumn("x", F.get("s", F.col("at"))).join(each, "x")
        first = F.floor(F.col("at") / F.col("n")).cast("int")
        near = near.withColumn("w", F.explode(F.array_distinct(F.array(first, F.greatest(first - 1, F.lit(0)))))).select("doc_id", "license", "t", "n", "m", F.slice("s", F.col("w") * F.col("n") + 1, 2 * F.col("n")).alias("window"))
        meets = None
        for b in range(BANDS):
            same = _minimum(F.col("window"), b) == F.get("m", F.lit(b))
            meets = same if meets is None else meets | same
        share = F.size(F.array_intersect("window", "t")) / F.col("n")
        got = near.where(meets).select("doc_id", "license", share.alias("containment")).where(F.col("containment") >= containment)
        got = got.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))
        found = save(got) if found is None else save(found.unionByName(got))
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, license string, containment double")
    by_doc = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("license")).alias("names"), F.max("containment").alias("containment"))
    ids = docs.select("doc_id").distinct()
    return ids.join(by_doc, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )


def oracle_sql() -> str:
    """The same by exact counting, in DuckDB: every window of every template, without signatures."""
    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
    shingles = f"CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i+{SHINGLE - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH notice(license, text) AS (VALUES {rows}),
tw AS (SELECT license, {words} AS w FROM notice),
t AS (SELECT license, list_distinct({shingles}) AS t FROM tw),
ts AS (SELECT license, len(t) AS n, unnest(t) AS x FROM t),
dw AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT doc_id, {shingles} AS s FROM dw),
ds AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS pos FROM d),
hit AS (SELECT doc_id, license, n, x, pos FROM ds JOIN ts USING (x)),
win AS (SELECT doc_id, license, n, x, unnest([pos // n, greatest(pos // n - 1, 0)]) AS w FROM hit),
got AS (SELECT doc_id, license, count(DISTINCT x) / n AS containment FROM win GROUP BY doc_id, license, n, w HAVING count(DISTINCT x) / n >= {CONTAINMENT}),
best AS (SELECT doc_id, license, max(containment) AS containment FROM got GROUP BY ALL),
by_doc AS (SELECT doc_id, count(*) AS n_licenses, string_agg(license, ',' ORDER BY license) AS licenses, max(containment) AS containment FROM best GROUP BY doc_id)
SELECT i.doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(containment, 0.0) AS containment
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) i LEFT JOIN by_doc USING (doc_id)
"""
