"""Similarity of vectors and texts, as column expressions and as plain functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; an error for vectors of different lengths."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    return F.coalesce(same, F.when(norm == 0, F.lit(0.0)).otherwise(_dot(a, b) / norm))


def cosine_of(a: list[float], b: list[float]) -> float:
    if len(a) != len(b):
        raise ValueError("vectors of different lengths")
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def characters(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(text, "")), "")


def hashed_lines(text: Column) -> Column:
    """Distinct hashes of the lines that are not blank."""
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.length(F.trim(x)) > 0)
    return F.array_distinct(F.transform(lines, lambda x: F.sha2(x, 256)))


def character_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(characters(a), characters(b))


def line_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(hashed_lines(a), hashed_lines(b))
