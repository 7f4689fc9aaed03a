"""Approximate search over the record table.

A query of n characters, of any length, matches a field if some substring of
the field is within ``floor(threshold * n)`` edits of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv

# Cells of the padded text matrix that are worked on at once.
CELLS = 1 << 20


def pieces(query: str, edits: int) -> list[str]:
    """Cut a query into ``edits + 1`` parts. Each edit can spoil one of them,
    so any match contains at least one part unchanged."""
    cuts = [round(i * len(query) / (edits + 1)) for i in range(edits + 2)]
    return [query[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def _slices(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indexes of texts of similar length, as many as fill ``CELLS`` when padded."""
    order = np.argsort(lengths, kind="stable")[::-1]
    at = 0
    while at < len(order):
        take = max(1, CELLS // max(1, int(lengths[order[at]])))
        yield order[at:at + take]
        at += take


def fewest_errors(texts: list[str], query: str) -> np.ndarray:
    """Fewest edits between the query and any substring of each text.

    One column of the edit matrix per text is carried along the texts' characters;
    a step of the column is taken for many texts at once, so a text costs its length
    times the query's.
    """
    pattern = np.frombuffer(query.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    best = np.full(len(texts), len(pattern), np.int32)
    for own in _slices(lengths):
        longest = int(lengths[own].max(initial=0))
        codes = np.zeros((longest, len(own)), "<u4")
        for i, k in enumerate(own):
            codes[:lengths[k], i] = np.frombuffer(texts[k].encode("utf-32-le", "surrogatepass"), "<u4")
        column = np.repeat(np.arange(len(pattern) + 1, dtype=np.int32)[:, None], len(own), axis=1)
        found, alive = best[own], np.arange(longest)[:, None] < lengths[own]
        for j in range(longest):
            above = column[0].copy()
            for i, p in enumerate(pattern, 1):
                left = column[i]
                value = np.minimum(np.minimum(above + (codes[j] != p), left + 1), column[i - 1] + 1)
                above, column[i] = left.copy(), value
            found = np.where(alive[j], np.minimum(found, column[-1]), found)
        best[own] = found
    return best


def _errors_of(query: str):
    @F.pandas_udf("int")
    def errors(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype="Int32")
        have = texts.notna().to_numpy()
        out[have] = fewest_errors(texts[have].tolist(), query)
        return out

    return errors


def _may_match(field: Column, query: str, edits: int) -> Column:
    """Cheap necessary condition: the field contains one of the pieces."""
    test = F.lit(False)
    for piece in sorted(set(pieces(query, edits))):
        test = test | field.contains(piece)
    return test


def _lists(rows: DataFrame, weights: Mapping[str, float]) -> set[str]:
    return {f.name for f in rows.schema if f.name in weights and f.dataType.typeName() == "array"}


def search(rows: DataFrame, query: str, weights: Mapping[str, float] = fv.SEARCH_WEIGHTS,
           threshold: float = fv.SEARCH_THRESHOLD, ranked: bool = False) -> DataFrame:
    """Rows in which any of the weighted fields matches the query.

    A blank query matches every row. ``ranked`` appends ``rank``: the weighted
    mean over the matching fields of errors per character, smaller is closer.
    The containment test runs inside generated code and rejects rows before the
    edit distances, which are computed in Arrow batches, field by field.
    """
    if not query.strip():
        return rows.withColumn("rank", F.lit(0.0)) if ranked else rows
    lists = _lists(rows, weights)
    wanted = query.lower()
    edits = math.floor(threshold * len(wanted))
    errors = _errors_of(wanted)

    def candidate(name: str) -> Column:
        if name in lists:
            return F.exists(name, lambda item: _may_match(F.lower(item), wanted, edits))
        return _may_match(F.lower(F.col(name)), wanted, edits)

    possible = F.lit(False)
    for name in weights:
        possible = possible | F.coalesce(candidate(name), F.lit(False))
    found = rows.where(possible)
    # Items of a list are compared as one text: no match reaches across the
    # break, which is as many characters long as a match may be.
    gap = "\x01" * (len(wanted) + edits + 1)
    texts = {n: F.lower(F.array_join(n, gap) if n in lists else F.col(n)) for n in weights}
    found = found.withColumns({f"_e_{n}": errors(F.when(candidate(n), t)) for n, t in texts.items()})
    hits = {n: F.when(F.col(f"_e_{n}") <= edits, F.col(f"_e_{n}") / len(wanted)) for n in weights}
    matched = F.lit(False)
    for hit in hits.values():
        matched = matched | hit.isNotNull()
    found = found.where(matched)
    if ranked:
        zero = F.lit(0.0)
        total, weight = zero, zero
        for name, share in weights.items():
            total = total + F.coalesce(hits[name] * share, zero)
            weight = weight + F.when(hits[name].isNotNull(), F.lit(float(share))).otherwise(zero)
        found = found.withColumn("rank", total / weight)
    return found.drop(*[f"_e_{n}" for n in weights])
