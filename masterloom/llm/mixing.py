"""Mixing sources to target weights by systematic sampling.

Each source has a target in words. Every document of a source is expected
``rate = target / source_size`` times in the mix; the expected copies are summed
along a fixed order of the source's documents, one random offset per source is
added, and a document is emitted once for each integer that its interval of the
running sum crosses. Documents are ordered by size, so the words taken miss the
target by less than the largest document of the source.

Only (source, size, digest of the id) leaves the scan. The running sum is never
built in one task per source: documents are counted by (source, size, digest
prefix), the counts are summed within a band of sizes, and bands are offset by
their totals, of which a source has a few hundred whatever its length.

Defined cases: null text has size 0; a null source is a source of its own, last
in order; null or repeated ids are rows of their own (rows equal in id, source and
text are interchangeable); a source without words has target 0 and no copies; an
empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import own_columns, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix"


def _key(source: Column) -> Column:
    """A join key that also holds null, in the order of the sources."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source_key, source_size, target) for a table with ``source_key`` and ``size``.

    The sources, in key order, weigh ``weights``, repeating. Together they get
    ``share`` times all words; a source gets at most ``most`` times its own, and
    what that leaves is shared again by weight. ``sizes`` is one aggregate;
    everything after it has one row per source.
    """
    per_source = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    sources = written(per_source.withColumn("weight", weight)
                      .withColumn("cap", F.col("source_size") * F.lit(float(most))), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = None  # words per unit of weight
    while True:
        full = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * F.lit(level)
        taken, left, n = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(~full, 1))).first()
        if not n:
            break
        risen = (share * total - taken) / left
        if level is not None and risen <= level:
            break
        level = risen
    target = F.least("cap", F.col("weight") * F.lit(float(level or 0.0)))
    return sources.select("source_key", "source_size", target.alias("target"))


def _band(size: Column) -> Column:
    """Band of sizes: eight to a doubling."""
    return F.floor(F.log2(size + F.lit(1.0)) * 8)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: str = SEED, text: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, mark.

    ``docs`` has doc_id, source and the text column; others are ignored. Emitting
    the mix is ``explode(sequence(1, copies))`` over the rows with copies; see
    :func:`emitted`.
    """
    rows = own_columns(docs, "doc_id", "source", text).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        _key(F.col("source").cast("string")).alias("source_key"), word_count(F.col(text)).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("digest"),
        _mark(F.col("doc_id").cast("long"), _key(F.col("source").cast("string")), F.col(text).cast("string")).alias("mark"))
    rows = written(rows, "mix-rows")
    targets = source_targets(rows, weights, share, most)

    # Order within a source: larger first, then by digest, then by id.
    part = F.substring("digest", 1, 2)
    counts = rows.groupBy("source_key", "size", part.alias("part")).agg(F.count("*").alias("n")).withColumn(
        "band", _band(F.col("size")))
    in_band = Window.partitionBy("source_key", "band").orderBy(F.desc("size"), "part").rowsBetween(Window.unboundedPreceding, -1)
    by_band = Window.partitionBy("source_key").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    bands = counts.groupBy("source_key", "band").agg(F.sum("n").alias("n")).select(
        "source_key", "band", F.coalesce(F.sum("n").over(by_band), zero).alias("bands_before"))
    starts = (
        counts.withColumn("within", F.coalesce(F.sum("n").over(in_band), zero))
        .join(bands, ["source_key", "band"])
        .join(targets, "source_key")
        .select("source_key", "size", "part", (F.col("bands_before") + F.col("within")).alias("before"),
                "source_size", "target"))
    place = F.row_number().over(
        Window.partitionBy("source_key", "size", "part").orderBy("digest", "doc_id", "mark"))
    placed = rows.withColumn("part", part).withColumn("place", place)

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("source_key"))), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)
    rank = F.col("before") + F.col("place")
    crossed = F.floor(rank * F.col("rate") + F.col("offset")) - F.floor((rank - 1) * F.col("rate") + F.col("offset"))
    return (
        placed.join(starts, ["source_key", "size", "part"])
        .withColumn("rate", rate).withColumn("offset", offset)
        .select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"), "mark"))


def _mark(doc_id: Column, source_key: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, source_key, text)


def emitted(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``copies`` says.

    ``copies`` is :func:`mix` of ``docs``. The texts move once, by the mark that
    both sides carry; rows equal in id, source and text get the copies of their
    group in turn.
    """
    left = docs.withColumn("_mark", _mark(
        F.col("doc_id").cast("long"), _key(F.col("source").cast("string")), F.col("text").cast("string")))
    right = copies.groupBy(F.col("mark").alias("_mark")).agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows"))
    turn = F.row_number().over(Window.partitionBy("_mark").orderBy("_mark"))
    own = F.floor(F.col("_all") * F.col("_turn") / F.col("_rows")) - F.floor(F.col("_all") * (F.col("_turn") - 1) / F.col("_rows"))
    return (
        left.join(right, "_mark").withColumn("_turn", turn).withColumn("_copies", own.cast("int")).where("_copies > 0")
        .select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
        .drop("_copy"))
