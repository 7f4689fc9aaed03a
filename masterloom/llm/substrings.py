"""Removing long repeated word runs by compacting a De Bruijn graph.

The edges of the graph are the k-mers of ``EDGE`` (20) consecutive words. An edge
that occurs at several places is a repeat; all but its first place, by (doc_id,
start), are removed. Edges don't travel one by one: consecutive edges of a document
that share a minimiser, the anchor k-mer of ``ANCHOR`` words with the smallest hash,
form one path and travel as one row, with the source coordinates of its first edge.
Equal edges have equal minimisers at equal offsets, so one shuffle by minimiser brings
all their places together. There, in order of coordinates, repeated edges are found
and runs of them compact into spans; a second shuffle glues the spans of a document,
and the join with the documents takes the words out.

Each task first compares the edges of a chunk of documents among themselves: paths
that only repeat what is in the chunk are decided there and stay, so copies and common
passages leave a task once. Anchors of very frequent passages are avoided as minimisers
where an edge has another one; which they are is estimated on a sample of texts, and
only affects how rows are spread, never what is removed.

Edges are compared by 48 bits of hash on top of the 64 bits of their minimiser and
the offset; two different edges agree in all of it with a chance of 2^-48 for each
pair that shares a minimiser.

Defined cases: null text has no words and comes back as an empty text with nothing
removed; documents shorter than an edge stay whole; a null doc_id counts as smallest; rows
with equal doc_id and text have equal coordinates and don't repeat each other; an empty
table gives no rows; other columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WordHashes, chunked, mixed, raw, run_hashes, split_words, text_slices

EDGE, ANCHOR = 20, 6
CHUNK_CHARS, WORDS_CHARS = 4_000_000, 250_000
SAMPLE, FREQUENT, MOST_FREQUENT = 0.02, 0.004, 1 << 14
BYTES = 6
LOWEST = -(1 << 63)
PATHS = "anchor long, doc long, tag int, pos int, back int, edges binary"
SPANS = "doc long, tag int, start int, stop int"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows as Python objects, a part of a batch at a time."""
    for part in text_slices(batches, "text", CHUNK_CHARS):
        *ids, text = part.columns
        yield list(zip(*(c.to_pylist() for c in ids), raw(text), strict=True))


def _laid_out(rows: list[tuple], hashes: WordHashes):
    """Word hashes of some texts in one array, with where each text starts. Words are
    objects for a few texts at a time only."""
    hashed, lengths = [], []
    for some in chunked(rows, lambda r: len(r[-1] or ""), WORDS_CHARS):
        words = [split_words(r[-1]) for r in some]
        lengths += map(len, words)
        hashed.append(hashes.of([w for ws in words for w in ws]))
    return np.concatenate(hashed), np.cumsum([0, *lengths])


def _anchor_order(anchors: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Rank of anchors as minimisers: by hash, frequent ones after all others."""
    rank = mixed(anchors) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, anchors), len(frequent) - 1)
        rank = np.where(frequent[at] == anchors, rank | np.uint64(1 << 63), rank)
    return rank


def _minimisers(rank: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest rank among the ``width`` from each on, the first of ties."""
    n = len(rank) - width + 1
    best, at = rank[:n].copy(), np.arange(n, dtype=np.int32)
    for i in range(1, width):
        here = rank[i:i + n]
        less = np.nonzero(here < best)[0]
        best[less] = here[less]
        at[less] = less + i
    return at


def _runs(keys: list[np.ndarray], position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs with equal keys and consecutive positions."""
    if not len(position):
        return np.empty(0, int), np.empty(0, int)
    new = np.ones(len(position), bool)
    new[1:] = position[1:] != position[:-1] + 1
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.nonzero(new)[0]
    return first, np.append(first[1:], len(position)) - 1


def _first_of(keys: np.ndarray) -> np.ndarray:
    """For each element the index of the first equal one."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    first = np.empty(len(keys), np.int32)
    first[order] = order[new][np.cumsum(new, dtype=np.int32) - 1]
    return first


def _repeated(keys: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether an equal element stands earlier, at another place."""
    first = _first_of(keys)
    return (doc[first] != doc) | (start[first] != start)


def find_frequent(edge: int = EDGE, anchor: int = ANCHOR):
    """Anchors that many documents of a chunk hold, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for rows in _chunks(batches):
            words, starts = _laid_out(rows, hashes)
            all_anchors = run_hashes(words, anchor)
            found = [np.unique(all_anchors[a:max(a, b - anchor + 1)]) for a, b in zip(starts, starts[1:])]
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            often = counts >= 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["anchor", "n"])

    return run


def cut_paths(frequent: np.ndarray, edge: int = EDGE, anchor: int = ANCHOR):
    """Rows of ``PATHS`` for (doc, tag, text) batches. Rows without edges are
    removed spans: from ``pos``, ``back`` words."""
    width = edge - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for rows in _chunks(batches):
            rows.sort(key=lambda r: r[0])
            words, starts = _laid_out(rows, hashes)
            edges = run_hashes(words, edge)
            if not len(edges):
                continue
            # Arrays of a chunk are many, so they are narrow and go when they are done with.
            anchors = run_hashes(words, anchor)
            del words
            at = _minimisers(_anchor_order(anchors, frequent), width)[:len(edges)]
            doc_of = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(starts))[:len(edges)]
            # Edges don't leave their text.
            index = np.nonzero(np.arange(edge, len(edges) + edge) <= starts[1:][doc_of])[0].astype(np.int32)
            if not len(index):
                continue
            edges, at, doc_of = edges[index], at[index], doc_of[index]
            ids = np.array([r[0] for r in rows], np.int64)
            tags = np.array([r[1] for r in rows], np.int32)
            starts = starts.astype(np.int32)
            start = index - starts[doc_of]
            repeated = _repeated(edges, ids[doc_of], start)

            r = np.nonzero(repeated)[0]
            a, b = _runs([doc_of[r]], index[r])
            spans = (doc_of[r[a]], start[r[a]], start[r[b]] + edge - start[r[a]])

            a, b = _runs([doc_of, at], index)
            # What is decided at either end of a path stays here.
            undecided = np.append(0, np.cumsum(~repeated))
            open_ = undecided[b + 1] > undecided[a]
            a, b = a[open_], b[open_]
            place = np.nonzero(~repeated)[0]
            a, b = place[undecided[a]], place[undecided[b + 1] - 1]
            del undecided, place, repeated, start
            raw = edges.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :BYTES]
            sizes = b - a + 1
            taken = np.repeat((a - np.append(0, np.cumsum(sizes)[:-1])).astype(np.int32), sizes)
            taken += np.arange(len(taken), dtype=np.int32)
            blob = pa.py_buffer(raw[taken])
            del raw, taken, edges
            offsets = np.append(0, np.cumsum(sizes)) * BYTES
            paths = pa.BinaryArray.from_buffers(
                pa.binary(), len(a), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), blob])
            yield _path_batch(anchors[at[a]].view(np.int64), ids[doc_of[a]], tags[doc_of[a]],
                              at[a] - starts[doc_of[a]], at[a] - index[a], paths)
            d, s, n = spans
            # Spans go where their document's hash sends them.
            yield _path_batch(mixed(ids[d].view(np.uint64)).view(np.int64), ids[d], tags[d], s, n,
                              pa.nulls(len(d), pa.binary()))

    return run


def _path_batch(anchor, doc, tag, pos, back, edges) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor), pa.array(doc), pa.array(tag), pa.array(pos.astype(np.int32)), pa.array(back.astype(np.int32)), edges],
        names=["anchor", "doc", "tag", "pos", "back", "edges"])


def _span_batch(doc, tag, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(tag), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))],
        names=["doc", "tag", "start", "stop"])


def compact_paths(edge: int = EDGE):
    """Spans of repeated edges from paths sorted by (anchor, doc, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_anchor, seen = None, (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            is_span = np.asarray(column["edges"].is_null())
            num = {n: np.asarray(column[n]) for n in ("anchor", "doc", "tag", "pos", "back")}
            if is_span.any():
                s = {n: v[is_span] for n, v in num.items()}
                yield _span_batch(s["doc"], s["tag"], s["pos"], s["pos"] + s["back"])
            path = np.nonzero(~is_span)[0]
            if not len(path):
                continue
            edges = column["edges"].take(pa.array(path))
            lengths = np.array([len(x) for x in edges.to_pylist()], np.int64) // BYTES
            raw = np.frombuffer(b"".join(edges.to_pylist()), np.uint8).reshape(-1, BYTES)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :BYTES] = raw
            row = np.repeat(path, lengths)
            step = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(lengths)[:-1]), lengths)
            anchor = num["anchor"][row]
            offset = num["back"][row] - step  # from the edge's start to its minimiser
            start, doc = num["pos"][row] - offset, num["doc"][row]
            key = mixed(wide.view("<u8").reshape(-1) ^ mixed(anchor.view(np.uint64) + offset.astype(np.uint64)))
            first = _first_of(key)
            first_doc, first_start = doc[first], start[first]
            if seen_anchor is not None and anchor[0] == seen_anchor and len(seen[0]):
                at = np.minimum(np.searchsorted(seen[0], key), len(seen[0]) - 1)
                known = (seen[0][at] == key) & (anchor == seen_anchor)
                first_doc, first_start = np.where(known, seen[1][at], first_doc), np.where(known, seen[2][at], first_start)
            repeated = (first_doc != doc) | (first_start != start)
            # What the last anchor has shown so far is held for the next batch.
            last = anchor == anchor[-1]
            keys, where = np.unique(key[last], return_index=True)
            held = (keys, first_doc[last][where], first_start[last][where])
            if seen_anchor is not None and anchor[-1] == seen_anchor:
                fresh = ~np.isin(seen[0], keys)
                held = tuple(np.concatenate([x[fresh], y]) for x, y in zip(seen, held))
                order = np.argsort(held[0])
                held = tuple(x[order] for x in held)
            seen_anchor, seen = anchor[-1], held
            r = np.nonzero(repeated)[0]
            a, b = _runs([row[r]], start[r])
            yield _span_batch(doc[r[a]], num["tag"][row[r[a]]], start[r[a]], start[r[b]] + edge)

    return run


def _without(names: list[str]):
    """Take the spans out of the texts of (columns..., starts, stops) batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", CHUNK_CHARS):
            n, gone, kept = [], [], []
            texts, starts, stops = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "_sd_starts", "_sd_stops"))
            for text, a, b in zip(raw(texts), starts, stops, strict=True):
                words = split_words(text)
                n.append(len(words))
                if not a.is_valid:
                    gone.append(0)
                    kept.append(b" ".join(words))
                    continue
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, np.asarray(a.values), 1)
                np.add.at(edges, np.asarray(b.values), -1)
                stay = np.cumsum(edges[:-1]) == 0
                gone.append(int(len(words) - stay.sum()))
                kept.append(b" ".join([words[i] for i in np.nonzero(stay)[0]]))
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*names, "n_words", "n_removed", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, edge: int = EDGE, anchor: int = ANCHOR) -> DataFrame:
    """Every row of ``docs`` with n_words, n_removed and kept_text: the words that no
    repeated run of ``edge`` words covers, joined by single spaces.

    ``docs`` needs doc_id and text and is read three times (a sample, the paths, the
    join); it should be a table.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    if dict(docs.dtypes)["text"] != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    tagged = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc"),
        F.hash("text").alias("tag"), "text")
    sampled = tagged.sample(SAMPLE, 7)
    counts = sampled.select("text").mapInArrow(find_frequent(edge, anchor), "anchor long, n long").groupBy("anchor").agg(
        F.sum("n").alias("n"))
    n = sampled.count()
    top = counts.where(F.col("n") >= max(4.0, FREQUENT * n)).orderBy(F.desc("n"), "anchor").limit(MOST_FREQUENT).collect()
    frequent = np.sort(np.array([r["anchor"] for r in top], np.int64).view(np.uint64))

    paths = tagged.mapInArrow(cut_paths(frequent, edge, anchor), PATHS)
    spans = paths.repartition("anchor").sortWithinPartitions("anchor", "doc", "pos").mapInArrow(compact_paths(edge), SPANS)
    per_doc = spans.groupBy("doc", "tag").agg(F.collect_list("start").alias("_sd_starts"), F.collect_list("stop").alias("_sd_stops"))
    keyed = docs.select(
        "*", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("_sd_id"),
        F.hash("text").alias("_sd_mark"))
    joined = keyed.join(per_doc.withColumnsRenamed({"doc": "_sd_doc", "tag": "_sd_tag"}),
                        (F.col("_sd_id") == F.col("_sd_doc")) & (F.col("_sd_mark") == F.col("_sd_tag")), "left")
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema),
                     "n_words long", "n_removed long", "kept_text string"])
    return joined.drop("_sd_id", "_sd_mark", "_sd_doc", "_sd_tag").mapInArrow(_without(names), out)
