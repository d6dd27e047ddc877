"""Text functions as columns: normalising, similarity, ids, masks, language."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_name(x: Column | str) -> Column:
    """Lower case, single spaces, no leading article."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(_c(x))), r"\s+", " "), r"^(the|a|an) ", "")


def normalize_predicate(x: Column | str) -> Column:
    return F.upper(F.regexp_replace(F.translate(F.trim(_c(x)), " -", "__"), "_+", "_"))


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """1 less the edit distance over the greater length, of normalised names."""
    x, y = normalize_name(a), normalize_name(b)
    return F.when(x == y, 1.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def ngrams(x: Column | str, n: int = 2) -> Column:
    """The distinct character n-grams of a text; of a shorter one, itself."""
    t = F.trim(F.lower(_c(x)))
    each = F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))
    return F.when(F.length(t) >= n, F.array_distinct(each)).otherwise(F.array(t))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def ngram_similarity(a: Column | str, b: Column | str, n: int = 2) -> Column:
    x, y = F.trim(F.lower(_c(a))), F.trim(F.lower(_c(b)))
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(jaccard(ngrams(a, n), ngrams(b, n)))


def is_korean(x: Column | str) -> Column:
    return _c(x).rlike("[가-힣ᄀ-ᇿ]")


def string_similarity(a: Column | str, b: Column | str) -> Column:
    return F.when(is_korean(a) | is_korean(b), ngram_similarity(a, b)).otherwise(edit_similarity(a, b))


#: Characters of pairs that are compared together.
_PAIR_CHARS = 1 << 20


def _codes(texts: list[str], fill: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), fill, np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<i4")
    return out


def jaro_winkler_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of pairs of texts, all pairs at once for each character of the longest."""
    out = np.zeros(len(a))
    length = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        end = min(len(order), at + max(1, int(_PAIR_CHARS // max(1, length[order[at]]))))
        while end > at + 1 and length[order[end - 1]] * (end - at) > _PAIR_CHARS:
            end = at + (end - at) // 2
        rows, at = order[at:end], end
        x, y = (_codes([t[i] for i in rows], fill) for t, fill in ((a, -1), (b, -2)))
        if not x.shape[1] or not y.shape[1]:
            out[rows] = [float(a[i] == b[i]) for i in rows]
            continue
        n, m = (np.array([len(t[i]) for i in rows]) for t in (a, b))
        reach = np.maximum(0, np.maximum(n, m) // 2 - 1)[:, None]
        place, every = np.arange(y.shape[1])[None], np.arange(len(rows))
        taken, mine = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
        for i in range(x.shape[1]):
            fits = (y == x[:, i : i + 1]) & ~taken & (place >= i - reach) & (place <= i + reach)
            first = fits.argmax(axis=1)
            hit = fits[every, first]
            taken[every[hit], first[hit]] = True
            mine[hit, i] = True
        count = mine.sum(axis=1)
        width = min(x.shape[1], y.shape[1])
        left, right = (np.take_along_axis(t, np.argsort(~used, axis=1, kind="stable"), axis=1)[:, :width] for t, used in ((x, mine), (y, taken)))
        swapped = ((left != right) & (np.arange(width)[None] < count[:, None])).sum(axis=1)
        safe = np.maximum(1, count)
        jaro = np.where(count > 0, (count / np.maximum(1, n) + count / np.maximum(1, m) + (count - swapped / 2) / safe) / 3, 0.0)
        four = min(4, width)
        same = np.cumprod(x[:, :four] == y[:, :four], axis=1).sum(axis=1)
        score = jaro + same * 0.1 * (1 - jaro)
        equal = np.array([a[i] == b[i] for i in rows])
        out[rows] = np.where(equal, 1.0, score)
    return out


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity with prefixes of up to four letters, without a threshold for the boost; null gives null."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = jaro_winkler_pairs(a[known].tolist(), b[known].tolist())
    return pd.Series(out, dtype="float64").where(known, None)


def entity_id(kind: Column | str, name: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(_c(kind), F.lit(":"), F.lower(F.trim(_c(name)))), 256), 1, 16)


def hash_id(parts: list[Column | str], n: int = 16) -> Column:
    """The first n hexadecimal digits of the SHA-256 of the parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *(_c(p).cast("string") for p in parts)), 256), 1, n)


def embedding_version(provider: Column, model: Column, dims: Column, version: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", provider, model, dims.cast("string"), version)), 1, 12)


def language(x: Column | str) -> Column:
    """ko, en, mixed or unknown, by the share of Hangul among Hangul and Latin letters."""
    hangul = F.length(F.regexp_replace(_c(x), "[^가-힣]", ""))
    latin = F.length(F.regexp_replace(_c(x), "[^A-Za-z]", ""))
    share = hangul / (hangul + latin)
    return F.when(hangul + latin == 0, "unknown").when(share > 0.7, "ko").when(share < 0.2, "en").otherwise("mixed")


def mask(x: Column | str) -> Column:
    return F.concat(F.lit("[ANON:"), F.substring(F.sha2(_c(x), 256), 1, 12), F.lit("]"))


def mask_ip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"^(\d+)\.(\d+)\.\d+\.\d+$", "$1.$2.xxx.xxx")


def white_ratio(x: Column | str) -> Column:
    """The share of spaces, line ends and tabs; 0 for an empty text."""
    n = F.length(_c(x))
    return F.when(n == 0, 0.0).otherwise((n - F.length(F.translate(_c(x), " \n\t", ""))) / n)


def ascii_ratio(x: Column | str) -> Column:
    n = F.length(_c(x))
    return F.when(n == 0, 0.0).otherwise(F.length(F.regexp_replace(_c(x), "[^\x01-\x7f]", "")) / n)


def cross_lingual(a: Column | str, b: Column | str) -> Column:
    x, y = ascii_ratio(a), ascii_ratio(b)
    return ((x > 0.8) & (y < 0.5)) | ((y > 0.8) & (x < 0.5))
