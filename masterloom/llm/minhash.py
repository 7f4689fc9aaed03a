"""Near-duplicate documents by BagMinHash.

A document is the multiset of its runs of ``SHINGLE`` words; documents are linked if
their weighted Jaccard similarity (sum of smaller counts over sum of larger ones) is
at least ``SIMILAR``. Linked documents and what they lead to are one group.

*Signatures.* Counts are discretised at the integers and cut into dyadic intervals
[0,1), [1,2), [2,4), ... Each shingle has a Poisson process per interval, with the
interval's length as rate; a point has a time, one of ``SLOTS`` slots and a place in
its interval, and counts if the place is below the shingle's count. The signature
holds the earliest time per slot, and two signatures agree in a slot with exactly the
weighted Jaccard similarity. Points are made in order of time and only up to a bound by
which all slots are filled (raised until they are), so a document of n shingles costs n
first points and about SLOTS * log(SLOTS) more, however large its counts.

*Candidates.* ``BANDS`` bands of ``DEPTH`` slots; a pair of similarity 0.8 shares none
of them with a chance of 3e-6. First a document is verified against the bucket pivots it
shares most bands with, which links most documents of large groups in linear work. Buckets
that still hold several components are then compared in slices of bounded size, only between
different components: in ``ROUNDS`` rounds in which each component has its most alike pair
verified, and then once for all pairs that are left. A pair counts in
the first band it shares, by the hashes that make the buckets, and only if signatures don't rule the similarity out (4.3 standard
deviations, by a wider signature made for these documents). No cap drops a pair.

*Verification* streams the texts to be compared with one document past it, in
slices, so hot pivots are spread and nothing is gathered.

Defined cases: equal texts are one class before anything is compared; texts without
words (null, empty) link with nothing; fewer words than a shingle make one shingle; a
null doc_id counts as smallest; rows equal in id and text are one document; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_run, written
from .common import freed
from .links import components
from .tokens import WordHashes, mixed, raw, run_hashes, split_words, text_slices

SHINGLE, SIMILAR = 5, 0.8
BANDS, DEPTH = 32, 5
SLOTS = BANDS * DEPTH
WIDE = 1024
PIVOTS, ROUNDS = 3, 2
SLICE, SPREAD = 2048, 256
CHUNK_CHARS = 1_000_000
MOST_AHEAD, POINTS_AT_ONCE = 256, 1 << 13
LOWEST = -(1 << 63)
# Four standard deviations of the share of equal slots below the similarity asked for.
DEVIATIONS = 4.3
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def least_agreement(similar: float, slots: int = SLOTS) -> float:
    return similar - DEVIATIONS * (similar * (1 - similar) / slots) ** 0.5


def bag(words: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, sorted, and their counts."""
    return np.unique(run_hashes(words, min(shingle, len(words))), return_counts=True)


def weighted_jaccard(a: tuple, b: tuple) -> float:
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    shared = np.minimum(a[1][same], b[1][at[same]]).sum()
    return shared / (a[1].sum() + b[1].sum() - shared)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mixed(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """Earliest time per slot, a row for each (non-empty) bag."""
    sizes = [len(b[0]) for b in bags]
    shingle = np.concatenate([b[0] for b in bags])
    count = np.concatenate([b[1] for b in bags])
    owner = np.repeat(np.arange(len(bags)), sizes)
    weight = np.add.reduceat(count, np.cumsum([0, *sizes[:-1]])).astype(float)
    # One process per shingle and dyadic interval below its count.
    parts, level, more = [(shingle, owner, count, np.ones(len(count)), np.zeros(len(count)))], 1, count > 1
    while more.any():
        low = float(1 << (level - 1))
        n = int(more.sum())
        parts.append((mixed(shingle[more] + np.uint64(level) * C3), owner[more], count[more], np.full(n, low), np.full(n, low)))
        level += 1
        more = count > (1 << (level - 1))
    seed, owner, count, rate, low = (np.concatenate(x) for x in zip(*parts))

    first = np.full(len(bags) * slots, np.inf)
    time = np.zeros(len(seed))
    step = np.zeros(len(seed), np.uint64)
    until = slots * (np.log(slots) + 3.0) / weight
    active = np.arange(len(seed))
    waiting = active[:0]
    while True:
        while len(active):
            # Few processes are left in short texts: several points of each at once.
            ahead = min(MOST_AHEAD, max(1, POINTS_AT_ONCE // len(active)))
            own = owner[active]
            s = mixed(seed[active][:, None] + (step[active][:, None] + np.arange(ahead, dtype=np.uint64)) * C1)
            gaps = -np.log(_uniform(s)) / rate[active][:, None]
            # Summed up one after the other, so that times don't depend on how many are drawn at once.
            now = np.add.accumulate(np.concatenate([time[active][:, None], gaps], axis=1), axis=1)[:, 1:]
            early = now < until[own][:, None]
            drawn = np.minimum(early.sum(axis=1) + 1, ahead)
            step[active] += drawn.astype(np.uint64)
            time[active] = now[np.arange(len(active)), drawn - 1]
            # The point that is too late now is the next one if the bound is raised.
            over = ~early[:, -1]
            waiting = np.concatenate([waiting, active[over]])
            process = np.broadcast_to(active[:, None], s.shape)[early]
            now, s = now[early], s[early]
            slot = (mixed(s + C2) % np.uint64(slots)).astype(np.int64)
            counts = np.floor(low[process] * (1 + _uniform(s + C3))) < count[process]
            np.minimum.at(first, owner[process[counts]] * slots + slot[counts], now[counts])
            active = active[~over]
        table = first.reshape(len(bags), slots)
        short = np.isinf(table).any(axis=1)
        if not short.any():
            return table
        until[short] *= 2
        late = waiting[short[owner[waiting]]]
        waiting = waiting[~short[owner[waiting]]]
        # Points already drawn but held back are taken up first.
        s = mixed(seed[late] + (step[late] - np.uint64(1)) * C1)
        early = time[late] < until[owner[late]]
        waiting = np.concatenate([waiting, late[~early]])
        late, s = late[early], s[early]
        slot = (mixed(s + C2) % np.uint64(slots)).astype(np.int64)
        counts = np.floor(low[late] * (1 + _uniform(s + C3))) < count[late]
        np.minimum.at(first, owner[late[counts]] * slots + slot[counts], time[late[counts]])
        active = late


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, text) to (doc, key, bands, sketch, hashes): a hash per band, a byte per slot, and
    the hashes of all bands as bytes."""
    hashes = WordHashes()
    for part in text_slices(batches, "text", CHUNK_CHARS):
        bags = [bag(hashes.of(split_words(t))) for t in raw(part.column(2))]
        bits = mixed(signatures(bags).view(np.uint64))
        del bags
        band = np.zeros((len(bits), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64) * C2
        for i in range(DEPTH):
            band = mixed(band * C1 + bits[:, i::DEPTH])
        slots = np.ascontiguousarray((bits & np.uint64(255)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([
            part.column(0), part.column(1),
            pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())),
            pa.array([x.tobytes() for x in slots], pa.binary()), pa.array([x.tobytes() for x in band], pa.binary())],
            names=["doc", "key", "bands", "sketch", "hashes"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Stretches of rows with equal first ``keys`` columns, from sorted batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if held and row[:keys] != held[-1][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _widely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, wide): a byte for each of ``WIDE`` slots."""
    hashes = WordHashes()
    for part in text_slices(batches, "text", CHUNK_CHARS):
        times = signatures([bag(hashes.of(split_words(t))) for t in raw(part.column(1))], WIDE)
        slots = np.ascontiguousarray((mixed(times.view(np.uint64)) & np.uint64(255)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in slots], pa.binary())], names=["id", "wide"])


def _stacked(rows: list[tuple], column: int, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), np.uint8).reshape(len(rows), width)


def _sided(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple], bool]]:
    """Both sides of each tile with two components or more, from rows (bucket, left, right,
    side, id, component, ...), and whether the sides are the same rows."""
    for rows in _groups(batches, 3):
        same = rows[0][1] == rows[0][2]
        sides = [[r for r in rows if r[3] == 0], [r for r in rows if r[3] == (0 if same else 1)]]
        if sides[0] and sides[1] and len({r[5] for r in rows}) > 1:
            yield *sides, same


def _partners(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, same: bool, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of one side the rows of the other of different components whose sketches
    agree enough, and in how many slots; pairs of one slice come once."""
    # The largest component is never compared with itself: its rows come last.
    values, counts = np.unique(cx, return_counts=True)
    order = np.argsort(cx == values[counts.argmax()], kind="stable")
    for place, i in enumerate(order):
        j = np.nonzero(cy != cx[i])[0] if not same else order[place + 1:][cy[order[place + 1:]] != cx[i]]
        if len(j):
            share = (y[j] == x[i]).mean(axis=1)
            j, share = j[share >= least], share[share >= least]
            if len(j):
                yield i, j, share


def _best(similar: float):
    """(a, b, share, component): for rows of a tile the partner with the most alike sketch.
    Rows of a bucket's largest component are partners only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, same in _sided(batches):
            x, y = _stacked(left, 6, SLOTS), _stacked(right, 6, SLOTS)
            cx, cy = (np.array([r[5] for r in s], np.int64) for s in (left, right))
            found = [(left[i][4], right[j[share.argmax()]][4], share.max(), cx[i])
                     for i, j, share in _partners(x, y, cx, cy, same, least_agreement(similar))]
            if found:
                own, other, share, component = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array(share, pa.float64()),
                     pa.array(component, pa.int64())], names=["a", "b", "share", "component"])

    return run


def _left(similar: float):
    """(bucket, id) of the rows of a tile that any partner may be similar to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, same in _sided(batches):
            x, y = _stacked(left, 6, SLOTS), _stacked(right, 6, SLOTS)
            cx, cy = (np.array([r[5] for r in s], np.int64) for s in (left, right))
            mine, others = np.zeros(len(left), bool), np.zeros(len(right), bool)
            for i, j, _ in _partners(x, y, cx, cy, same, least_agreement(similar)):
                mine[i] = True
                others[j] = True
            ids = [r[4] for r, use in zip(left, mine) if use] + [r[4] for r, use in zip(right, others) if use]
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([left[0][0]] * len(ids), pa.int64()), pa.array(ids, pa.int64())], names=["bucket", "id"])

    return run


def _all(similar: float):
    """(a, b) of the pairs of a tile that may be similar, in the first band they share."""
    wide = least_agreement(similar, WIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, same in _sided(batches):
            (x, y), (wx, wy) = ([_stacked(s, c, n) for s in (left, right)] for c, n in ((6, SLOTS), (7, WIDE)))
            bx, by = (_stacked(s, 8, BANDS * 8).view(np.uint64) for s in (left, right))
            cx, cy, ids, others = (np.array([r[c] for r in s], np.int64) for c in (5, 4) for s in (left, right))
            bucket, a, b = np.int64(left[0][0]).astype(np.uint64), [], []
            for i, j, _ in _partners(x, y, cx, cy, same, least_agreement(similar)):
                # Slots are bytes here and may agree by chance where the bucket differs.
                shared = by[j] == bx[i]
                own = bx[i][shared.argmax(axis=1)] == bucket
                j = j[own & ((wy[j] == wx[i]).mean(axis=1) >= wide)]
                a.append(np.minimum(ids[i], others[j]))
                b.append(np.maximum(ids[i], others[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _verify(similar: float, shingle: int):
    """Pairs that hold, from rows (a, slice, member, id, text) sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, own = WordHashes(), None, None
        for batch in batches:
            a, b = [], []
            for pivot, part, member, id_, text in zip(
                    *(batch.column(i).to_pylist() for i in range(4)), raw(batch.column(4)), strict=True):
                found = bag(hashes.of(split_words(text)), shingle)
                if not member:
                    at, own = (pivot, part), found
                elif at == (pivot, part) and weighted_jaccard(own, found) >= similar:
                    a.append(pivot)
                    b.append(id_)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) are similar. The text of ``b`` moves to
    ``a``; that of ``a`` is repeated for each slice in use."""
    sliced = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int").alias("part"))
    members = sliced.join(texts, F.col("b") == F.col("id")).select("a", "part", F.lit(1).alias("member"), "id", "text")
    pivots = sliced.select("a", "part").distinct().join(texts, F.col("a") == F.col("id")).select(
        "a", "part", F.lit(0).alias("member"), "id", "text")
    return members.unionByName(pivots).repartition("a", "part").sortWithinPartitions("a", "part", "member", "id").mapInArrow(
        _verify(similar, shingle), "a long, b long")


def near_documents(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc, key, class_id, component_id) for each distinct id and text of ``docs``.

    ``doc`` is the id (null as the lowest long), ``key`` a digest of the text. Tables
    written on the way are removed once the classes are known.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    with scratch_run(docs.sparkSession):
        known = written(_classes(rows, similar), "near-known", outlive=True)
    return rows.select("doc", "key").join(known, "key", "left").select(
        "doc", "key", F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("component_id", "doc").alias("component_id"))


def _classes(rows: DataFrame, similar: float) -> DataFrame:
    """(key, class_id, component_id) of the distinct texts with words of ``rows`` (doc, key, text)."""
    spark = rows.sparkSession
    worded = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    sketched = worded.select("doc", "key", "text").mapInArrow(_sketch, "doc long, key binary, bands array<long>, sketch binary, hashes binary")
    # A class of equal texts goes by a hash of its key; ids may repeat.
    reps = written(sketched.groupBy("key").agg(
        F.min("doc").alias("doc"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("hashes").alias("hashes"))
        .withColumn("id", F.xxhash64("key")), "near-classes")

    banded = reps.select("id", F.explode("bands").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(crowded, "bucket").select("bucket", "id", "pivot"), "near-members")
    shared = members.where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("bands"))
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("bands"), "pivot"))
    best = shared.withColumn("turn", turn).where(F.col("turn") <= PIVOTS)
    chosen = reps.select(F.col("key").alias("_key"), F.col("doc").alias("_doc"), "id").join(members.select("id").distinct(), "id")
    texts = written(
        worded.join(chosen, (F.col("key") == F.col("_key")) & (F.col("doc") == F.col("_doc")))
        .dropDuplicates(["key", "doc"]).select("id", "text"), "near-texts")
    freed(spark)
    links = written(verified(best.select(F.col("pivot").alias("a"), F.col("id").alias("b")), texts, similar), "near-links")
    labels = written(components(links), "near-labels")

    wide = texts.join(_mixed_up(members, labels).select("id").distinct(), "id").select("id", "text").mapInArrow(
        _widely, "id long, wide binary")
    sketches = written(reps.select("id", "sketch", "hashes").join(wide, "id").select("id", "sketch", "wide", "hashes"), "near-sketches")
    for find in [_best_pairs] * ROUNDS + [_all_pairs]:
        pairs = written(find(members, sketches, labels, similar), "near-pairs")
        fresh = written(verified(pairs, texts, similar), "near-links")
        freed(spark)
        if not fresh.isEmpty():
            # Components found so far are stars already.
            known = labels.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
            labels = written(components(known.unionByName(fresh)), "near-labels")
    named = reps.select("key", F.col("doc").alias("class_id"), "id").join(labels, "id", "left").select(
        "key", "class_id", F.coalesce("component", "id").alias("label"))
    named = written(named, "near-named")
    smallest = written(named.groupBy("label").agg(F.min("class_id").alias("component_id")), "near-smallest")
    return named.join(smallest, "label").select("key", "class_id", "component_id")


def _mixed_up(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, id, component, n, big, n_big): members of buckets that hold several components,
    with the sizes of the bucket and of its largest component ``big``."""
    placed = members.join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds"),
        F.max_by(F.struct("component", "n"), F.struct("n", "component")).alias("big")).where("kinds > 1")
    return placed.join(sizes.select("bucket", "n", F.col("big.component").alias("big"), F.col("big.n").alias("n_big")), "bucket")


def _tiles(mixed_up: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows of tiles (bucket, left, right, side, id, component, *sketches), sorted. The members
    outside a bucket's largest component are cut into slices and each two slices are a tile;
    each slice also meets all slices of the largest component, whose rows therefore go to one
    tile each where the others fit a slice. ``sketches`` has the columns to be compared."""
    slices = lambda n: F.ceil(n / F.lit(SLICE)).cast("int")
    read = mixed_up.withColumns({
        "n_own": slices(F.col("n") - F.col("n_big")), "n_largest": slices(F.col("n_big")), "largest": F.col("component") == F.col("big")})
    read = read.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("largest"), F.col("n_largest")).otherwise(F.col("n_own"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda left, right, side: F.struct(left.alias("left"), right.alias("right"), side.cast("int").alias("side"))
    own, one = F.col("own"), F.lit(1)
    # Slices of the largest component count down from -1.
    as_largest = F.transform(every(F.col("n_own")), lambda o: place(o, -1 - own, one))
    with_largest = F.transform(every(F.col("n_largest")), lambda o: place(own, -1 - o, F.lit(0)))
    with_others = F.transform(every(F.col("n_own")), lambda o: place(F.least(own, o), F.greatest(own, o), own > o))
    tiles = read.select("bucket", "id", "component", F.explode(
        F.when(F.col("largest"), as_largest).otherwise(F.concat(with_largest, with_others))).alias("tile"))
    rows = tiles.join(sketches, "id").select(
        "bucket", "tile.left", "tile.right", "tile.side", "id", "component", *[c for c in sketches.columns if c != "id"])
    return rows.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "side", "id")


def _best_pairs(members: DataFrame, sketches: DataFrame, labels: DataFrame, similar: float) -> DataFrame:
    """(a, b): the pair of each component whose sketches agree most with those of another."""
    found = _tiles(_mixed_up(members, labels), sketches.select("id", "sketch")).mapInArrow(
        _best(similar), "a long, b long, share double, component long")
    return found.groupBy("component").agg(F.max_by(F.struct("a", "b"), F.struct("share", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def _all_pairs(members: DataFrame, sketches: DataFrame, labels: DataFrame, similar: float) -> DataFrame:
    """(a, b) of all pairs that share a bucket, are of different components and may be similar.
    The long signatures move only for members that a short one leaves a partner."""
    left = _tiles(_mixed_up(members, labels), sketches.select("id", "sketch")).mapInArrow(_left(similar), "bucket long, id long")
    left = written(left.distinct(), "near-left")
    return _tiles(_mixed_up(left, labels), sketches).mapInArrow(_all(similar), "a long, b long")


def deduplicated(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` of which one is kept for each group: the smallest id."""
    found = near_documents(docs, similar).where("doc = component_id").select(
        F.col("doc").alias("_nd_own"), F.col("key").alias("_nd_own_key")).distinct()
    keyed = docs.withColumns({
        "_nd_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)),
        "_nd_key": F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))})
    kept = keyed.join(found, (F.col("_nd_doc") == F.col("_nd_own")) & (F.col("_nd_key") == F.col("_nd_own_key")), "left_semi")
    repeats = docs.groupBy("doc_id", F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).count().where("count > 1")
    if not repeats.isEmpty():
        turn = F.row_number().over(Window.partitionBy("_nd_doc", "_nd_key").orderBy("_nd_key"))
        kept = kept.withColumn("_nd_turn", turn).where("_nd_turn = 1").drop("_nd_turn")
    return kept.drop("_nd_doc", "_nd_key")
