"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords: the 2-, 3- and 4-grams of
its lower-cased words, with a mark at either end, hashed into ``BUCKETS`` rows. A
linear softmax over that mean gives the languages. Embeddings and softmax are
trained together by stochastic gradient descent in numpy, on a sample of labelled
texts of at most ``PER_LABEL`` a language and ``SAMPLE`` in all (chosen by a hash of
the id). A fifth of the sample is kept back to calibrate: a temperature makes the
scores probabilities, and a text is rejected if its best language is less likely
right than ``REJECT_BELOW``.

Prediction reads whole texts, in Arrow batches, without a shuffle. Words are scored
once per worker and remembered; memory is bounded by the number of words held.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; rows without label, or with a null id, aren't learnt from; with one label
every text with letters gets it with score 1; with none all are ``und``; repeated rows
and other columns don't matter to a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_columns
from .tokens import chunked, split_words

BUCKETS, DIMENSIONS = 1 << 14, 16
PER_LABEL, SAMPLE = 400, 2000
STEPS, BATCH, RATE = 2000, 32, 0.5
REJECT_BELOW = 0.5
UNKNOWN = "und"
# What may be a letter: numerals such as ``½`` or ``Ⅷ`` are sorted out after it.
LETTER = re.compile(r"[^\W\d_]")
GRAMS = (2, 3, 4)
BLOCK = 1 << 18
WORDS_HELD = 200_000


def _grams(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, bucket) of the subwords of some words, in blocks."""
    text = (b"<" + b">\n<".join(words) + b">").decode()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    breaks = codes == 10
    word = np.cumsum(breaks)
    for at in range(0, len(codes), BLOCK):
        h = np.zeros(min(BLOCK, len(codes) - at), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            have = min(len(h), len(codes) - at - n + 1)
            if have <= 0:
                break
            h = h[:have] * np.uint64(0x100000001B3) + codes[at + n - 1:at + n - 1 + have] + np.uint64(n)
            if n in GRAMS:
                own = (word[at:at + have] == word[at + n - 1:at + n - 1 + have]) & ~breaks[at:at + have]
                x = h[own]
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                yield word[at:at + have][own], (x >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the share of its subwords in each."""
    counts = Counter(split_words(text.lower().encode()))
    if not counts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    times = np.fromiter(counts.values(), float, len(counts))
    total = np.zeros(BUCKETS)
    for word, bucket in _grams(list(counts)):
        total += np.bincount(bucket, times[word], BUCKETS)
    found = np.nonzero(total)[0]
    return found.astype(np.int32), (total[found] / total.sum()).astype(np.float32)


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 17) -> Model:
    """Train on (buckets, shares) of texts; every fifth is kept to calibrate."""
    names = tuple(sorted(set(labels)))
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, b = np.zeros((DIMENSIONS, len(names))), np.zeros(len(names))
    if len(names) < 2:
        return Model(names, e, w, b, 1.0)
    truth = np.array([names.index(x) for x in labels])
    order = rng.permutation(len(texts))
    kept, train = order[::5], np.delete(order, np.arange(0, len(order), 5))
    # A number of steps, not of rounds: a small sample is gone through more often.
    done = 0
    while done < STEPS and len(train):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            part = [i for i in train[at:at + BATCH] if len(texts[i][0])]
            rate, done = RATE * max(0.0, 1 - done / STEPS), done + 1
            if not part:
                continue
            shares = np.zeros((len(part), BUCKETS), np.float32)
            for row, i in zip(shares, part):
                row[texts[i][0]] = texts[i][1]
            mean = shares @ e
            error = _softmax(mean @ w + b)
            error[np.arange(len(part)), truth[part]] -= 1
            back = shares.T @ (error @ w.T).astype(np.float32)
            w -= rate * mean.T @ error / len(part)
            b -= rate * error.mean(axis=0)
            e -= rate * DIMENSIONS * back
    logits = np.array([(e[x] * s[:, None]).sum(axis=0) @ w + b for x, s in (texts[i] for i in kept)])

    def loss(t: float) -> float:
        return -np.log(_softmax(logits / t)[np.arange(len(kept)), truth[kept]] + 1e-12).mean()

    temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    return Model(names, e, w, b, float(temperature))


def _read_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_features(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in made], pa.list_(pa.int32())),
             pa.array([x[1] for x in made], pa.list_(pa.float32()))], names=["lang", "buckets", "shares"])


def train(docs: DataFrame, learn: Column, per_label: int = PER_LABEL, sample: int = SAMPLE) -> Model:
    """Fit on rows of ``docs`` (doc_id, text, lang) where ``learn`` holds.

    The sample is chosen on ids and labels alone, with a limit per label before
    the shuffle; only its texts are read, and only their features are gathered.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    # ``crc32`` is used to choose what to learn from, another hash to sample.
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rows.select("doc_id", "lang").distinct().withColumn("turn", turn).where(F.col("turn") <= per_label)
    chosen = chosen.orderBy("turn", F.xxhash64("doc_id"), "doc_id", "lang").limit(sample).select("doc_id", "lang")
    # At most ``sample`` ids.
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")
    texts = texts.groupBy("doc_id", "lang").agg(F.max("text").alias("text")).select("lang", "text")
    got = texts.mapInArrow(_read_features, "lang string, buckets array<int>, shares array<float>").toArrow()
    langs = got["lang"].to_pylist()
    features = list(zip(_arrays(got["buckets"], np.int32), _arrays(got["shares"], np.float32)))
    # Rows come in any order; training starts from a fixed one.
    order = sorted(range(len(features)), key=lambda i: (langs[i], features[i][0].tobytes(), features[i][1].tobytes()))
    return fit([features[i] for i in order], [langs[i] for i in order])


def _arrays(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The lists of a column, as views of its flat values."""
    out = []
    for chunk in column.chunks:
        values, ends = np.asarray(chunk.values, kind), np.asarray(chunk.offsets)
        out += [values[a:b] for a, b in zip(ends, ends[1:])]
    return out


class _Scorer:
    """Sums of embeddings per word, remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, int] = {}
        self.sums = np.zeros((0, DIMENSIONS))
        self.counts = np.zeros(0)

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > WORDS_HELD:
            self.known.clear()
            self.sums, self.counts = self.sums[:0], self.counts[:0]
        new = sorted(set(words).difference(self.known))
        if new:
            sums, counts = np.zeros((len(new), DIMENSIONS)), np.zeros(len(new))
            for part in self._parts(new):
                base, group = part
                for word, bucket in _grams(group):
                    # Positions run through the words in order: sum stretches of equal word.
                    first = np.nonzero(np.append(True, word[1:] != word[:-1]))[0] if len(word) else word
                    if len(word):
                        sums[base + word[first]] += np.add.reduceat(self.model.embeddings[bucket], first)
                        counts[base + word[first]] += np.diff(np.append(first, len(word)))
            start = len(self.counts)
            self.known.update(zip(new, range(start, start + len(new))))
            self.sums, self.counts = np.concatenate([self.sums, sums]), np.concatenate([self.counts, counts])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    @staticmethod
    def _parts(words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
        base = 0
        for group in chunked(((w,) for w in words), lambda r: len(r[0]) + 3, BLOCK):
            yield base, [r[0] for r in group]
            base += len(group)


def predictor(model: Model, reject_below: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            at = batch.schema.get_field_index("_lid_text")
            labels, scores = [], []
            for rows in chunked(((t or "",) for t in batch.column(at).to_pylist()), lambda r: len(r[0]), 1_000_000):
                found = _judge(model, scorer, [r[0] for r in rows])
                labels += found[0]
                scores += found[1]
            scores = pa.array(scores, pa.float64())
            accepted = pa.array([x != UNKNOWN and s >= reject_below for x, s in zip(labels, scores.to_pylist())])
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(labels, pa.string()), scores, accepted], names=[*names, "lang_pred", "score", "accepted"])

    return run


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def _judge(model: Model, scorer: _Scorer, texts: list[str]) -> tuple[list[str], list[float]]:
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    own = [i for i, t in enumerate(texts) if model.labels and has_letter(t)]
    if not own:
        return labels, scores
    words = [split_words(texts[i].lower().encode()) for i in own]
    codes = scorer.codes([w for ws in words for w in ws])
    begins = np.cumsum([0, *map(len, words)])[:-1]
    # Mean over the words held, a stretch of them at a time.
    mean = np.array([scorer.sums[c].sum(axis=0) / scorer.counts[c].sum() for c in np.split(codes, begins[1:])])
    p = _softmax((mean @ model.weights + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    for i, k, s in zip(own, best, p.max(axis=1)):
        labels[i], scores[i] = model.labels[k], float(min(1.0, s))
    return labels, scores


def predict(docs: DataFrame, model: Model, reject_below: float = REJECT_BELOW) -> DataFrame:
    """Every row of ``docs`` with lang_pred, score and accepted; only the text is read."""
    docs = docs.drop("lang_pred", "score", "accepted")
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema),
                     "lang_pred string, score double, accepted boolean"])
    return docs.withColumn("_lid_text", F.col("text").cast("string")).mapInArrow(predictor(model, reject_below), out)


def labelled(docs: DataFrame) -> DataFrame:
    return own_columns(docs, "doc_id", "text", "lang").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"))
