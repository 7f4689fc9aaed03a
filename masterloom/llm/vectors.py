"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors of cosine ``c`` or more are unit vectors at a squared distance of at most
``2 - 2c``. A fixed rotation spreads that distance over the coordinates, which are cut
into blocks; each block has a budget, its share of the squared distance in proportion to
its width. A linked pair stays within budget in some block at least (else the sum would be
above), so the pairs within budget in any block hold all links.

Distinct vectors are dealt to slices, and each pair of slices is a tile, joined in one task for
all blocks. Slices grow with the table, so that a vector goes to at most ``MOST_SLICES`` tiles (more only
beyond ``LARGEST`` rows a slice): what is shuffled grows with the table, not with its square. In a tile
each block is range-joined: both sides are ordered by the block's first coordinate, some rows of the one
meet those of the other within the block's reach, and one matrix product tells which pairs are within
budget. No pair is ever emitted: a task counts the links of its vectors, and gives
those counts and a spanning forest of its links. A pair that several blocks find counts
once. Every candidate is verified by its cosine in double precision. The work still
grows with the square of the number of distinct vectors.

Equal vectors are joined as one with their number. Only the components as given are shuffled.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing, and are components of their own; vectors of different lengths never
link; rows with equal id are rows of their own (each gets a row with the links of
its vector; they count as linked copies if equal); rows with a null id link like others, never
give a component its number, and are kept only if no row of it has an id (component_id is
null then); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import freed
from .links import components

COSINE = 0.9
BLOCK_WIDTH = 16
SLICE = 8192
MOST_SLICES, LARGEST = 24, 1 << 16  # slices are larger than SLICE rather than more, up to LARGEST rows
MOST_PARTS = 2000
SLACK = 1e-4
ROWS_AT_ONCE, COLUMNS_AT_ONCE = 256, 1024
PAIRS_AT_ONCE = 50_000
# Ids lie below this; classes without one are numbered from here.
UNNAMED = 1 << 62


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """A fixed random orthonormal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int, width: int = BLOCK_WIDTH) -> list[tuple[int, int]]:
    n = max(1, round(dims / width))
    cuts = [round(i * dims / n) for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of equal length, none of them null, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _sides(turned: np.ndarray, a: int, b: int, budget: float, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One block of the rows of one side in the order of its first coordinate, that order, and that coordinate. Two columns
    more make the product of a left and a right row half of what their squared distance leaves of the budget."""
    order = np.argsort(turned[:, a], kind="stable")
    part = turned[order, a:b]
    half, one = (part * part).sum(axis=1, keepdims=True) / 2, np.ones((len(part), 1), np.float32)
    more = (-half, one) if left else (one, np.float32(budget / 2) - half)
    return np.ascontiguousarray(np.hstack([part, *more]), np.float32), order, part[:, 0]


def _set(near: np.ndarray) -> np.ndarray:
    """Places of the few true values in the flat array, looked for eight at a time."""
    flat = near.ravel()
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (eights[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], np.flatnonzero(flat[whole:]) + whole])


def _candidates(x: np.ndarray, y: np.ndarray, cuts, budgets, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rotated rows that are within budget in some block, each once."""

    def first_found(j: int, pairs: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        u, v = (np.concatenate(side) for side in zip(*pairs))
        if same:
            u, v = u[u < v], v[u < v]
        for k in range(0, len(u), PAIRS_AT_ONCE):
            s, t = u[k:k + PAIRS_AT_ONCE], v[k:k + PAIRS_AT_ONCE]
            own = _passing(x[s], y[t], cuts, budgets)
            own = own[:, j] & ~own[:, :j].any(axis=1)
            yield s[own], t[own]

    for j, ((a, b), budget) in enumerate(zip(cuts, budgets)):
        left, order, first = _sides(x, a, b, budget + SLACK, True)
        right, other_order, other_first = _sides(y, a, b, budget + SLACK, False)
        right, reach = np.ascontiguousarray(right.T), math.sqrt(budget) + SLACK
        pairs, held = [], 0
        for at in range(0, len(left), ROWS_AT_ONCE):
            rows = left[at:at + ROWS_AT_ONCE]
            low, high = np.searchsorted(other_first, first[at] - reach), np.searchsorted(other_first, first[at + len(rows) - 1] + reach, "right")
            for start in range(low, high, COLUMNS_AT_ONCE):
                some = right[:, start:min(start + COLUMNS_AT_ONCE, high)]
                found = _set(rows @ some >= 0)
                if len(found):
                    pairs.append((order[found // some.shape[1] + at], other_order[found % some.shape[1] + start]))
                    held += len(found)
                if held > PAIRS_AT_ONCE:
                    yield from first_found(j, pairs)
                    pairs, held = [], 0
        if held:
            yield from first_found(j, pairs)


def _passing(left: np.ndarray, right: np.ndarray, cuts, budgets) -> np.ndarray:
    """Per pair of rotated rows and block: is the squared distance within budget?"""
    gap = left.astype(np.float64) - right
    gap *= gap
    return np.stack([np.add.reduce(gap[:, a:b], axis=1) <= budget for (a, b), budget in zip(cuts, budgets)], axis=1)


class _Forest:
    """The components of numbered vertices, as the least vertex of each."""

    def __init__(self, size: int):
        self.least = np.arange(size)

    def join(self, x: np.ndarray, y: np.ndarray) -> list[int]:
        """Link each pair; the places of pairs that span what is linked thereby."""
        a, b = self.least[x], self.least[y]
        apart = np.nonzero(a != b)[0]
        if not len(apart):
            return []
        low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        _, first = np.unique(low * len(self.least) + high, return_index=True)
        up: dict[int, int] = {}

        def root(v: int) -> int:
            while (w := up.get(v, v)) != v:
                up[v] = up.get(w, w)
                v = w
            return v

        spanning = []
        for at, v, w in zip(apart[first].tolist(), low[first].tolist(), high[first].tolist()):
            v, w = root(v), root(w)
            if v != w:
                up[max(v, w)] = min(v, w)
                spanning.append(at)
        to = np.arange(len(self.least))
        for v in up:
            to[v] = root(v)
        self.least = to[self.least]
        return spanning


def _join_slices(cosine: float, width: int):
    """Links between the two sides of one tile: (a, null, n) counts, (a, b, null) forest."""
    total = 2 - 2 * cosine

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"])
        same = key[1] == key[2]
        sides = []
        for which in (0, 1):
            part = table.filter(pa.array(side == which)).sort_by("id")
            sides.append((np.asarray(part["id"], np.int64), np.asarray(part["copies"], np.int64), part["vector"]))
        if same:
            sides[1] = sides[0]
        (ids, copies, p), (other_ids, other_copies, q) = sides
        out = {"a": [ids[:0]], "b": [ids[:0]], "n": [ids[:0]]}
        if len(ids) and len(other_ids):
            dims = int(key[0].as_py())
            cuts = blocks_of(dims, width)
            budgets = [total * (b - a) / dims + SLACK for a, b in cuts]
            unit = _unit(_matrix(p))
            other_unit = unit if same else _unit(_matrix(q))
            turn = rotation(dims)
            turned = (unit @ turn).astype(np.float32)
            other_turned = turned if same else (other_unit @ turn).astype(np.float32)
            counts, other_counts = np.zeros(len(ids)), np.zeros(len(other_ids))
            beyond = 0 if same else len(ids)
            forest = _Forest(beyond + len(other_ids))
            for u, v in _candidates(turned, other_turned, cuts, budgets, same):
                linked = (unit[u] * other_unit[v]).sum(axis=1) >= cosine
                u, v = u[linked], v[linked]
                if not len(u):
                    continue
                counts += np.bincount(u, other_copies[v], len(ids))
                other_counts += np.bincount(v, copies[u], len(other_ids))
                spanning = forest.join(u, v + beyond)
                out["a"].append(ids[u[spanning]])
                out["b"].append(other_ids[v[spanning]])
            edges = sum(map(len, out["a"]))
            for of, n in [(ids, counts + other_counts)] if same else [(ids, counts), (other_ids, other_counts)]:
                out["a"].append(of[n > 0])
                out["n"].append(n[n > 0].astype(np.int64))
        else:
            edges = 0
        a, b, n = (np.concatenate(out[c]).astype(np.int64) for c in ("a", "b", "n"))
        return pa.table({"a": pa.array(a), "b": pa.concat_arrays([pa.array(b), pa.nulls(len(n), pa.int64())]),
                         "n": pa.concat_arrays([pa.nulls(edges, pa.int64()), pa.array(n)])})

    return run


def tiles(classes: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """(dims, left, right, side, id, copies, vector): the rows of ``classes`` once for each pair of slices that theirs is in.
    Slice ``left`` is side 0 of a tile, ``right`` side 1; a tile of a slice with itself has one side."""
    rows = classes.withColumn("dims", F.size("vector"))
    n = F.count("*")
    slices = F.least(F.ceil(n / slice_rows), F.greatest(F.lit(MOST_SLICES), F.ceil(n / LARGEST)))
    sizes = rows.groupBy("dims").agg(slices.cast("int").alias("slices"))
    parts = sizes.agg(F.sum(F.col("slices") * (F.col("slices") + 1) / 2)).first()[0] or 1
    rows = rows.join(F.broadcast(sizes), "dims")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.select("dims", F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"),
                       (F.col("mine") > F.col("other")).cast("int").alias("side"), "id", "copies", "vector")
    # The tasks have little to read and much to do, so they are not put together by size.
    return rows.repartition(min(MOST_PARTS, int(parts)), "dims", "left", "right")


def near_vectors(rows: DataFrame, cosine: float = COSINE, width: int = BLOCK_WIDTH, slice_rows: int = SLICE,
                 id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept, class_id."""
    spark = rows.sparkSession
    every = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    every = every.withColumn("ok", usable(F.col("vector")))
    # -0.0 equals 0.0 in a cosine; adding zero makes them one.
    good = every.where("ok").select("vec_id", F.transform("vector", lambda x: x + F.lit(0.0).cast("float")).alias("vector"))
    # Vectors that only rows without an id have are classes too, numbered above all ids.
    unnamed = F.lit(UNNAMED) + F.xxhash64("vector").bitwiseAND(F.lit(UNNAMED - 1))
    classes = good.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("id", F.coalesce("id", unnamed)), "vec-classes")
    found = written(tiles(classes, slice_rows).groupBy("dims", "left", "right").applyInArrow(
        _join_slices(cosine, width), "a long, b long, n long"), "vec-links")
    freed(spark)
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    labels = components(found.where("b IS NOT NULL").select("a", "b"))
    known = written(
        classes.join(counts, "id", "left").join(labels, "id", "left")
        .select(F.col("id").alias("class_id"), "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component_id")), "vec-known")
    members = every.select("vec_id", "ok", F.when(F.col("ok"), F.transform("vector", lambda x: x + F.lit(0.0).cast("float"))).alias("vector"))
    joined = members.join(known, "vector", "left")
    named = lambda name: F.when(F.col(name) < UNNAMED, F.col(name))
    component = F.coalesce(named("component_id"), "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.when(F.col("vec_id").isNull(), component.isNull()).otherwise(F.col("vec_id") == component).alias("kept"),
        F.coalesce(named("class_id"), "vec_id").alias("class_id"))
