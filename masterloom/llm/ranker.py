"""Quality scores by pairwise ranking after Bradley and Terry.

Of a pair of labelled texts the one of label 1 is preferred; the chance that ``a`` beats
``b`` is the sigmoid of the difference of their scores. Scores are linear in features of the
text, so a preference is a logistic loss on a difference of features, learnt by stochastic
gradient descent over pairs drawn anew at each step.

Features are the square roots of the shares of byte-class trigrams (``CLASSES``: letters by
case, digits, white space, kinds of punctuation, others), which tell shouting, markup,
tables and noise from prose in any language, and four measures of length and repetition.

A text counts as good from a quantile of scores on, by default the share of label 0 among
all labelled rows. Scores are shown as chances: a sigmoid with a temperature fitted on a
fifth of the rows that isn't learnt from, moved so that the quantile has ``CUT``.

Every labelled text takes part. Up to ``PER_LABEL`` texts of each label are learnt from in one
go. More are dealt by a hash of the id to parts of about twice that, each part is learnt
from in a task of its own, and the weights are the mean of those of the parts (parallel
stochastic gradient descent after Zinkevich et al.); the quantile and the temperature then come
from the scores of all rows, counted by Spark. Scoring reads whole texts, in blocks, without
a shuffle.

Defined cases: a null text is an empty one, which is scored like any other; rows with a null
id or label aren't learnt from, and an id with several labels or texts counts with the least
label and the greatest text; labels other than 0 are 1; with one label only all scores are
that label, with none 0.5; repeated rows and other columns don't matter; no rows give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_run, written
from .common import own_columns

PER_LABEL = 1000
# Rows of a label that a part has at least, if there are as many; the scarcer label is repeated for that.
PART_LABEL = 200
# Weights and losses are summed as integers, so that no order of rows matters.
UNIT = float(1 << 32)
BUCKETS, GATHERED = 1000, 10_000
STEPS, PAIRS, RATE, DECAY = 3000, 64, 0.01, 1e-3
CUT = 0.7
BLOCK = 1 << 20

# Bytes that mean alike for quality; every other byte is of one more class.
CLASSES = (
    bytes(range(ord("a"), ord("z") + 1)), bytes(range(ord("A"), ord("Z") + 1)), b"0123456789", b" ", b"\t\x0b\x0c\r", b"\n",
    b".", b",", b"!?", b"-'\"", b":;()[]{}<>/", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0)),
)
KINDS = len(CLASSES) + 1
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _kind, _bytes in enumerate(CLASSES):
    CLASS_OF[list(_bytes)] = _kind
SIZE = KINDS ** 3 + 4


def features(text: bytes) -> np.ndarray:
    """Features of a UTF-8 text."""
    counts = np.zeros(KINDS ** 3)
    for at in range(0, max(0, len(text) - 2), BLOCK):
        kinds = CLASS_OF[np.frombuffer(text[at:at + BLOCK + 2], np.uint8)]
        counts += np.bincount((kinds[:-2] * KINDS + kinds[1:-1]) * KINDS + kinds[2:], minlength=KINDS ** 3)
    words, lines = text.split(), text.split(b"\n")
    measures = (
        math.log1p(len(text)) / 10,
        len(set(words)) / max(1, len(words)),
        len(set(lines)) / len(lines),
        min(30.0, len(text) / max(1, len(words))) / 10,
    )
    return np.concatenate([np.sqrt(counts / max(1, len(text) - 2)), measures]).astype(np.float32)


@dataclass(frozen=True)
class Ranker:
    """``sigmoid(sharpness * (weights . features - offset) + shift)``; ``fixed`` is the score
    of every text if the labels allow no pair."""

    weights: np.ndarray
    offset: float
    sharpness: float
    shift: float
    fixed: float | None = None

    def score(self, x: np.ndarray) -> float:
        if self.fixed is not None:
            return self.fixed
        z = self.sharpness * (float(self.weights @ x) - self.offset) + self.shift
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def weighted_quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The middle between the values on either side of the share of all weight."""
    order = np.argsort(values, kind="stable")
    values, below = values[order], np.cumsum(weights[order]) / weights.sum()
    at = min(int(np.searchsorted(below, share - 1e-9)), len(values) - 1)
    return float(values[at] + values[min(at + 1, len(values) - 1)]) / 2


def _learnt_weights(z: np.ndarray, labels: np.ndarray, learnt: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    good, bad = learnt[labels[learnt] == 1], learnt[labels[learnt] == 0]
    w = np.zeros(SIZE)
    for step in range(STEPS):
        apart = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
        surprise = 1 / (1 + np.exp(np.clip(apart @ w, -50, 50)))
        w += RATE * (1 - step / STEPS) * (apart.T @ surprise / PAIRS - DECAY * w)
    return w


def _losses(scores: np.ndarray, labels: np.ndarray, threshold: float, sharpness: float, cut: float) -> np.ndarray:
    margin = np.where(labels == 1, 1, -1) * (sharpness * (scores - threshold) + math.log(cut / (1 - cut)))
    return np.logaddexp(0, -margin)


SHARPNESSES = np.geomspace(0.05, 20, 61)


def fit(x: np.ndarray, labels: np.ndarray, totals: tuple[int, int], quantile: float | None = None, cut: float = CUT,
        seed: int = 29) -> Ranker:
    """Learn from features and labels (0 or 1) of a sample; ``totals`` are the numbers of
    rows with either label that the sample stands for."""
    present = set(labels.tolist())
    if len(present) < 2:
        return Ranker(np.zeros(SIZE), 0.0, 1.0, 0.0, float(min(present, default=0.5)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    kept, learnt = order[::5], np.delete(order, np.arange(0, len(order), 5))
    if len(set(labels[learnt].tolist())) < 2 or len(set(labels[kept].tolist())) < 2:
        kept = learnt = order
    centre, spread = x[learnt].mean(axis=0), x[learnt].std(axis=0) + 0.02
    z = (x - centre) / spread
    w = _learnt_weights(z, labels, learnt, rng)
    scores = z @ w
    weights = np.where(labels == 1, totals[1] / (labels == 1).sum(), totals[0] / (labels == 0).sum())
    threshold = weighted_quantile(scores, weights, totals[0] / sum(totals) if quantile is None else quantile)

    def loss(sharpness: float) -> float:
        return float((weights[kept] * _losses(scores[kept], labels[kept], threshold, sharpness, cut)).sum())

    sharpness = min(SHARPNESSES, key=loss)
    weights_x = w / spread
    return Ranker(weights_x, float(centre @ weights_x) + threshold, float(sharpness), math.log(cut / (1 - cut)))


def _read_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t or b"").tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["doc_id", "label", "x"])


def _learn_part(rows: pa.Table) -> pa.Table:
    """The weights learnt from one part, as (place, weight) in units; none if a label is lacking."""
    rows = rows.sort_by("doc_id")
    labels, learnt = rows["label"].to_numpy().astype(int), np.flatnonzero(rows["learnt"].to_numpy())
    if len(set(labels[learnt].tolist())) < 2:
        weights = np.zeros(0)
    else:
        x = np.stack([features(t.as_py() or b"") for t in rows["text"]])
        spread = x[learnt].std(axis=0) + 0.02
        z = (x - x[learnt].mean(axis=0)) / spread
        weights = _learnt_weights(z, labels, learnt, np.random.default_rng(29)) / spread
    return pa.table({"place": pa.array(np.arange(len(weights)), pa.int32()), "weight": pa.array(np.rint(weights * UNIT), pa.int64())})


def _marks_of(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [float(weights @ features(t.as_py() or b"")) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.float64())], names=["label", "tuned", "mark"])

    return run


def _losses_of(threshold: float, weights: tuple[float, float], cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = np.where(labels == 1, weights[1], weights[0])
            sums = [int(np.rint(own * _losses(marks, labels, threshold, s, cut) * 1e6).astype(np.int64).sum()) for s in SHARPNESSES]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.int64())], names=["at", "loss"])

    return run


def spread_quantile(marked: DataFrame, weights: tuple[float, float], share: float, gathered: int = GATHERED) -> float:
    """:func:`weighted_quantile` of ``marked`` (label, mark), a *written* table of any size, with a
    weight per label. Equal marks are ordered by label.

    Rows are counted in ``BUCKETS`` ranges of marks, then in those of the range that holds
    the quantile, until that has few rows or a single value.
    """
    ends = marked.agg(F.min("mark").alias("low"), F.max("mark").alias("high")).first()
    low, high, before, after, target = ends["low"], ends["high"], 0.0, None, None
    while True:
        inside = marked.where(F.col("mark").between(low, high))
        place = F.least(F.floor((F.col("mark") - low) / ((high - low) or 1.0) * BUCKETS), F.lit(BUCKETS - 1))
        found = inside.groupBy(place.alias("at")).agg(
            F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good"),
            F.min("mark").alias("low"), F.max("mark").alias("high")).orderBy("at").collect()
        if target is None:
            total = sum(weights[0] * r["bad"] + weights[1] * r["good"] for r in found)
            target = (share - 1e-9) * total
        for here, row in enumerate(found):
            mass = weights[0] * row["bad"] + weights[1] * row["good"]
            if before + mass >= target or here == len(found) - 1:
                break
            before += mass
        after = found[here + 1]["low"] if here + 1 < len(found) else after
        low, high = row["low"], row["high"]
        if low == high:
            last = weights[1] if row["good"] else weights[0]
            return (low + (after if after is not None and before + mass - last < target else low)) / 2
        if row["bad"] + row["good"] <= gathered:
            break
    got = sorted((r["mark"], r["label"]) for r in marked.where(F.col("mark").between(low, high)).collect())
    for at, (mark, label) in enumerate(got):
        before += weights[label]
        if before >= target:
            break
    following = got[at + 1][0] if at + 1 < len(got) else mark if after is None else after
    return (mark + following) / 2


def _fit_in_parts(texts: DataFrame, totals: tuple[int, int], per_label: int, quantile: float | None, cut: float) -> Ranker:
    """:func:`fit` on a *written* table (doc_id, label, text) of any size."""
    spared = (F.pmod(F.xxhash64("doc_id", F.lit("spared")), F.lit(5)) == 0)
    sizes = {(r["label"], r["spared"]): r["n"] for r in texts.groupBy("label", spared.alias("spared")).agg(F.count("*").alias("n")).collect()}
    n = [sum(v for (own, _), v in sizes.items() if own == label) for label in (0, 1)]
    if 0 in n:
        return fit(np.zeros((0, SIZE)), np.array([label for label in (0, 1) if n[label]]), totals)
    # With too few rows for both, all are learnt from and all set the temperature.
    apart = len(sizes) == 4
    parts = -(-sum(n) // (2 * per_label))
    copies = [min(parts, max(1, -(-PART_LABEL * parts // k))) for k in n]
    # A row's parts follow one another from a hash of its id on.
    repeats = F.sequence(F.lit(0), F.when(F.col("label") == 1, copies[1]).otherwise(copies[0]) - 1)
    dealt = texts.withColumns({"learnt": ~spared if apart else F.lit(True), "_copy": F.explode(repeats)}).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", F.lit("part")) + F.col("_copy"), F.lit(parts)).cast("int"))
    learnt = dealt.select("part", "doc_id", "label", "learnt", "text").repartition(min(parts, 2000), "part").groupBy("part").applyInArrow(
        _learn_part, "place int, weight long")
    weights = np.zeros(SIZE)
    for row in learnt.groupBy("place").agg(F.sum(F.col("weight").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n")).collect():
        weights[row["place"]] = float(row["sum"]) / UNIT / row["n"]

    marked = written(texts.select("label", (spared if apart else F.lit(True)).alias("tuned"), "text").mapInArrow(
        _marks_of(weights), "label int, tuned boolean, mark double"), "marks")
    own = (totals[0] / n[0], totals[1] / n[1])
    threshold = spread_quantile(marked.select("label", "mark"), own, totals[0] / sum(totals) if quantile is None else quantile)
    losses = marked.where("tuned").select("label", "mark").mapInArrow(_losses_of(threshold, own, cut), "at int, loss long").groupBy("at").agg(
        F.sum(F.col("loss").cast("decimal(38,0)")).alias("loss")).collect()
    best = min(losses, key=lambda r: (r["loss"], r["at"]))["at"]
    return Ranker(weights, threshold, float(SHARPNESSES[best]), math.log(cut / (1 - cut)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_label: int | None = None, quantile: float | None = None,
          cut: float = CUT) -> Ranker:
    """Fit on all texts of ``docs`` (doc_id, text) whose rows in ``labels`` (doc_id, label) satisfy
    ``learn``, in parts if there are many.

    A caller may ask for a quick fit on a sample, ``per_label`` rows of each label: it is chosen on
    ids and labels alone, after a count per label, as the lowest hashes of a range of
    hashes that holds about twice the rows wanted.
    """
    rows = labels.where(learn & F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min((F.col("label") != 0).cast("int")).alias("label"))
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return fit(np.zeros((0, SIZE)), np.zeros(0, int), (0, 0))
    both = (totals.get(0, 0), totals.get(1, 0))
    chosen = rows
    if per_label is not None:
        place = F.xxhash64("doc_id", F.lit("sample")).bitwiseAND((1 << 53) - 1)
        chosen = None
        for label, n in sorted(totals.items()):
            share = min(1.0, (2 * per_label + 100) / n)
            part = rows.where((F.col("label") == label) & (place <= int(share * (1 << 53)))).orderBy(place, "doc_id").limit(per_label)
            chosen = part if chosen is None else chosen.unionByName(part)
    few = per_label is not None or max(both) <= PER_LABEL
    # Few ids go to every task.
    texts = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(chosen) if few else chosen, "doc_id").groupBy("doc_id", "label").agg(
        F.max(F.col("text").cast("string")).alias("text")).select("doc_id", "label", F.col("text").cast("binary"))
    if not few:
        with scratch_run(docs.sparkSession):
            return _fit_in_parts(written(texts, "labelled"), both, PER_LABEL, quantile, cut)
    got = texts.mapInArrow(
        _read_features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, x binary").toArrow()
    # Rows come in any order; training starts from a fixed one.
    got = got.sort_by("doc_id")
    x = np.array([np.frombuffer(v.as_buffer(), np.float32) for v in got["x"]]).reshape(-1, SIZE)
    return fit(x, got["label"].to_numpy().astype(int), both, quantile, cut)


def _scorer(model: Ranker, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            scores = [model.score(features(t.as_py() or b"")) for t in batch.column(last)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], pa.array(scores, pa.float64()), pa.array([s >= cut for s in scores], pa.bool_())],
                names=[*batch.schema.names[:last], "quality_score", "good"])

    return run


def score(docs: DataFrame, model: Ranker, cut: float = CUT) -> DataFrame:
    """``docs`` without its text, with quality_score (0 to 1) and good appended; columns of
    these names are replaced."""
    kept = docs.drop("quality_score", "good").withColumn("_text", F.col("text").cast("string").cast("binary")).drop("text")
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "quality_score double, good boolean"])
    return kept.mapInArrow(_scorer(model, cut), out)


def with_label(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label) of a table of labels."""
    own = own_columns(labels, "doc_id", name)
    return own.select("doc_id", F.col(name).cast("int").alias("label"))
