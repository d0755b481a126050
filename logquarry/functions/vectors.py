"""Vector expressions on array columns."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry import dims
from logquarry.functions.text import TERM_PATTERN, drop_stop_words


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    length = norm(a) * norm(b)
    return F.coalesce(dot(a, b) / F.nullif(length, F.lit(0.0)), F.lit(0.0))


def similarity_from_distance(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance)


def hashing_encoder(width: int = 64, stop_words: list[str] | None = None):
    """Default text encoder: word counts hashed to ``width`` places, unit length.

    Any Arrow UDF ``string -> array<double>`` (or float) of one fixed length can replace it.
    Equal texts of a batch are encoded once.
    """
    stops = frozenset(dims.STOP_WORDS if stop_words is None else stop_words)

    @F.arrow_udf("array<double>")
    def encode(texts: pa.Array) -> pa.Array:
        words = re.compile(TERM_PATTERN)
        place = lru_cache(maxsize=200_000)(
            lambda word: int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % width
        )

        def one(text):
            places = [place(w) for w in words.findall(text.lower()) if w not in stops]
            counts = np.bincount(np.array(places, dtype=np.int64), minlength=width).astype(np.float64)
            length = np.sqrt(counts @ counts)
            return counts / length if length else counts

        coded = texts.fill_null("").dictionary_encode()
        unique = np.empty((len(coded.dictionary), width))
        for i, text in enumerate(coded.dictionary):
            unique[i] = one(text.as_py())
        flat = unique[coded.indices.to_numpy()].ravel()
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * width, flat)

    return encode


def hashed_words(text: Column, width: int = 64, stop_words: list[str] | None = None) -> Column:
    """What ``hashing_encoder`` computes, as an expression without Python: array<double> of ``width`` places.

    Null and wordless texts get the zero vector.
    """
    words = drop_stop_words(
        F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM_PATTERN), F.lit(0)), stop_words)
    places = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % width)
    counts = F.transform(F.array(places), lambda found: F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(found, lambda x: x == i)).cast("double")))
    return F.transform(counts, lambda c: F.transform(F.array(norm(c)), lambda length: F.transform(
        c, lambda x: F.when(length > 0, x / length).otherwise(0.0)))[0])[0]
