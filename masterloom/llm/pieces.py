"""SentencePiece encoding and decoding with a shared-prefix forward pass.

A text becomes marked words (spaces turn into the mark and stay with the word that
follows). The distinct words of a chunk are sorted, which lays out their trie depth
first, and each word starts from the forward states it shares with the one before:
only characters after the common prefix are worked on.

The state of a prefix depends on the model. For a unigram model it is the best score
of any segmentation and the start of its last piece (Viterbi). For a BPE model, such
as the one the queries use, scores are merge ranks and a best sum means nothing; but the
encoding of every prefix still is one piece after the encoding of a shorter prefix,
namely the only piece that merging would not join differently with the piece before it.
So the state is the start of that piece, found by the same forward pass, and results are
those of the merges. Characters outside the model become bytes, or the unknown piece
where the model has none.

Nothing is trained; the model file is a parameter. It is read by the driver and goes to
the tasks as a broadcast variable (32,000 short pieces). Encoding is one pass over the
texts without a shuffle; a worker remembers at most ``WORDS_HELD`` words.

Defined cases: a null text has no pieces and decodes to an empty text; a mark in a text is
encoded, and comes back, as a space; repeated rows and other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MARK = "▁"
MARK_BYTES = MARK.encode()
# What a word is: a text, marks and what follows up to the next, or that with line breaks apart.
WHOLE, WORDS, LINES = r"(?s).+", r"(?s)▁*[^▁]+|▁+", r"▁*[^▁\n]+|\n|▁+"
WORDS_HELD = 300_000
CHUNK_BYTES = 2_000_000
UNKNOWN_PENALTY = 10.0
PAIRS_HELD = 300_000
# Ends of prefixes remembered, and of how many characters such an end is.
ENDS_HELD, WINDOW = 50_000, 3
# Bytes of text that one Arrow array of a batch may hold, ids decoded at a time.
MOST_BYTES, IDS_AT_ONCE = 1 << 30, 1 << 18


@dataclass
class PieceModel:
    """What a model file says: pieces with scores, bytes and the unknown piece."""

    bpe: bool
    ids: dict[str, int]
    scores: dict[str, float]
    bytes: list[int]
    unknown: int
    text: list[str]
    longest: int
    word: str
    add_prefix: bool = True
    whole: set[str] = field(default_factory=set)


def load_model(path: str) -> PieceModel:
    """Read a model file whose normaliser leaves texts as they are."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return from_proto(model)


def from_proto(model) -> PieceModel:
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models without text normalisation are supported")
    ids, scores, values, unknown, text = {}, {}, [-1] * 256, 0, []
    for i, p in enumerate(model.pieces):
        text.append(p.piece if p.type in (1, 4, 5) else "")
        if p.type == 1:
            ids[p.piece], scores[p.piece] = i, p.score
        elif p.type == 2:
            unknown = i
        elif p.type == 6:
            values[int(p.piece[3:-1], 16)] = i
        elif p.type == 4:
            raise ValueError("user-defined pieces are not supported")
    # A word ends where no piece goes on: before a mark that follows another
    # character and, if no piece holds one, around line breaks.
    if any(MARK in p.lstrip(MARK) for p in ids):
        word = WHOLE
    elif any("\n" in p for p in ids):
        word = WORDS
    else:
        word = LINES
    return PieceModel(
        bpe=model.trainer_spec.model_type == 2, ids=ids, scores=scores,
        bytes=values if model.trainer_spec.byte_fallback else [], unknown=unknown, text=text,
        longest=max(map(len, ids), default=1), word=word, add_prefix=model.normalizer_spec.add_dummy_prefix)


def marked(text: str, model: PieceModel) -> str:
    text = text.replace(" ", MARK)
    return MARK + text if text and model.add_prefix else text


def merging(symbols: str, model: PieceModel) -> tuple[list[str], list[tuple[float, str, str]]]:
    """Plain merging: the best-scored neighbouring pair first, the left one of ties. The parts that
    are left, and the score of each merge with the first and the last part after it."""
    parts, steps = list(symbols), []
    while True:
        best = None
        for i in range(len(parts) - 1):
            score = model.scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best[0]):
                best = (score, i)
        if best is None:
            return parts, steps
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        steps.append((best[0], parts[0], parts[-1]))


ONE = (1,)
NO_MERGE = (float("-inf"), "", "")


class Encoder:
    """Encodes sorted words, with the forward states of shared prefixes."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.pairs: dict[tuple[str, str], bool] = {}
        self.steps: dict[str, list[tuple[float, str, str]] | None] = {}
        self.ending: dict[str, tuple[tuple[int, str | None, int], ...]] = {}
        self.entries: dict[str | int, tuple[int, str | None, int]] = {}
        self.worst = min(model.scores.values(), default=0.0) - UNKNOWN_PENALTY
        # Lengths of the pieces that end in two characters, longest first: no others are tried.
        ends: dict[str, set[int]] = {}
        # Lengths of the pieces longer than a window, by the window they end in.
        self.long: dict[str, set[int]] = {}
        for piece in model.ids:
            if len(piece) > 1:
                ends.setdefault(piece[-2:], set()).add(len(piece))
            if len(piece) > WINDOW:
                self.long.setdefault(piece[-WINDOW:], set()).add(len(piece))
        self.lengths = {end: (*sorted(found, reverse=True), 1) for end, found in ends.items()}

    def _merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece, and the end of them; None if it isn't what merging makes."""
        if piece not in self.steps:
            if len(self.steps) > ENDS_HELD:
                self.steps.clear()
            parts, steps = merging(piece, self.model)
            self.steps[piece] = [*steps, NO_MERGE] if parts == [piece] else None
        return self.steps[piece]

    def _pieces_ending(self, window: str) -> tuple[tuple[int, str | None, int], ...]:
        """Size, text and id of the pieces that may end a prefix, from its last characters; longest
        first. Those longer than the window have no text: it is still to be looked up."""
        if len(self.ending) > ENDS_HELD:
            self.ending.clear()
            self.entries.clear()
        ids, one = self.model.ids, self.entries
        found = [one.setdefault(size, (size, None, -1)) for size in sorted(self.long.get(window, ()), reverse=True)]
        for size in self.lengths.get(window[-2:], ONE):
            piece = window[-size:]
            if size == 1 or size <= len(window) and piece in ids and self._merges(piece):
                found.append(one.setdefault(piece, (size, piece, ids.get(piece, -1))))
        self.ending[window] = tuple(found)
        return self.ending[window]

    def _next_to(self, before: str, piece: str) -> bool:
        """Whether merging keeps the two pieces apart. Until something joins them, their own merges
        follow each other by score, those of the left one first."""
        if len(self.pairs) > PAIRS_HELD:
            self.pairs.clear()
        left, right, scores = self._merges(before), self._merges(piece), self.model.scores
        last, first, i, j = before[-1], piece[0], 0, 0
        while True:
            across, one, two = scores.get(last + first), left[i][0], right[j][0]
            if across is not None and across > one and across >= two:
                found = False
                break
            if left[i] is NO_MERGE and right[j] is NO_MERGE:
                found = True
                break
            if one >= two:
                last, i = left[i][2], i + 1
            else:
                first, j = right[j][1], j + 1
        self.pairs[before, piece] = found
        return found

    def _encode_bpe(self, words: list[str]) -> list[list[int]]:
        ending, pairs, every, out = self.ending, self.pairs, self.model.ids, []
        # By length of prefix: where its last piece starts, that piece and its id.
        before, start, last, ids = "", [0], [""], [-1]
        for word in words:
            n, limit = 0, min(len(before), len(word))
            while n < limit and before[n] == word[n]:
                n += 1
            del start[n + 1:], last[n + 1:], ids[n + 1:]
            for i in range(n + 1, len(word) + 1):
                window = word[i - WINDOW:i] if i > WINDOW else word[:i]
                for size, piece, known in ending.get(window) or self._pieces_ending(window):
                    j = i - size
                    if piece is None:
                        if j < 0 or (piece := word[j:i]) not in every or not self._merges(piece):
                            continue
                        known = every[piece]
                    if j == 0:
                        break
                    apart = pairs.get((last[j], piece))
                    if apart is None:
                        apart = self._next_to(last[j], piece)
                    if apart:
                        break
                else:
                    raise AssertionError(f"no piece ends at {i} of {word!r}")
                start.append(j)
                last.append(piece)
                ids.append(known)
            found, i = [], len(word)
            while i > 0:
                if ids[i] >= 0:
                    found.append(ids[i])
                else:
                    found += self._without_piece(last[i])
                i = start[i]
            found.reverse()
            out.append(found)
            before = word
        return out

    def _without_piece(self, character: str) -> list[int]:
        """Ids of a character outside the model, last first."""
        model = self.model
        return [model.bytes[b] for b in reversed(character.encode("utf-8", "replace"))] if model.bytes else [model.unknown]

    def _forward_unigram(self, word: str, start: list[int], score: list[float], i: int) -> None:
        best, at = None, i - 1
        for size in self.lengths.get(word[i - 2:i], ONE):
            j = i - size
            if j < 0:
                continue
            s = self.model.scores.get(word[j:i])
            if s is None:
                if j < i - 1:
                    continue
                s = self.worst
            if best is None or score[j] + s > best:
                best, at = score[j] + s, j
        start.append(at)
        score.append(best)

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the sorted ``words``."""
        return self._encode_bpe(words) if self.model.bpe else self._encode_unigram(words)

    def _encode_unigram(self, words: list[str]) -> list[list[int]]:
        model, out = self.model, []
        before, start, score = "", [0], [0.0]
        for word in words:
            n, limit = 0, min(len(before), len(word))
            while n < limit and before[n] == word[n]:
                n += 1
            del start[n + 1:], score[n + 1:]
            for i in range(n + 1, len(word) + 1):
                self._forward_unigram(word, start, score, i)
            found, i = [], len(word)
            while i > 0:
                piece = word[start[i]:i]
                known = model.ids.get(piece)
                found += self._without_piece(piece) if known is None else [known]
                i = start[i]
            out.append(found[::-1])
            before = word
        return out


class _Words:
    """Ids of words in one flat array, for the words met lately."""

    def __init__(self, model: PieceModel):
        self.encoder = Encoder(model)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)

    def look_up(self, words: list[str]) -> np.ndarray:
        if len(self.known) > WORDS_HELD:
            self.clear()
        new = sorted(set(words).difference(self.known))
        if new:
            ids = self.encoder.encode(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(lengths)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def _split(texts: pa.Array, model: PieceModel) -> tuple[pa.Array, np.ndarray]:
    """The words of marked texts, which leave nothing out, and how many each text has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    if model.word != WHOLE:
        mark = np.zeros(len(data), bool)
        if len(data) > 2:
            mark[:-2] = (data[:-2] == MARK_BYTES[0]) & (data[1:-1] == MARK_BYTES[1]) & (data[2:] == MARK_BYTES[2])
        at = np.nonzero(mark)[0]
        follows = np.zeros(len(at), bool)
        follows[1:] = np.diff(at) == 3
        begins[at[~follows]] = True
        if model.word == LINES:
            at = np.nonzero(data == 10)[0]
            begins[at] = begins[at + 1] = True
    ends = np.nonzero(begins)[0]
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))
    return words, np.diff(np.searchsorted(ends, offsets))


def encode_texts(texts: list[str] | pa.Array, model: PieceModel, words: _Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and where each text's begin. No text is null."""
    words = words or _Words(model)
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
    texts = pc.replace_substring(texts, " ", MARK)
    if model.add_prefix:
        led, none = pa.scalar(MARK, texts.type), pa.scalar("", texts.type)
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(led, texts, none))
    split, lengths = _split(texts, model)
    split = split.dictionary_encode()
    codes = words.look_up(split.dictionary.to_pylist())[split.indices.to_numpy()]
    first, size = words.begin[codes], words.begin[codes + 1] - words.begin[codes]
    ends = np.cumsum(size)
    ids = words.flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.append(0, ends)[np.append(0, np.cumsum(lengths))]
    return ids, bounds


def decode_ids(ids: list[int], model: PieceModel, byte_of: dict[int, int]) -> str:
    out, held = [], bytearray()
    for i in ids:
        if i in byte_of:
            held.append(byte_of[i])
            continue
        if held:
            out.append(held.decode("utf-8", "replace"))
            held.clear()
        out.append(model.text[i] if i != model.unknown else " ⁇ ")
    if held:
        out.append(held.decode("utf-8", "replace"))
    text = "".join(out).replace(MARK, " ")
    return text[1:] if model.add_prefix and text.startswith(" ") else text


# Words of the model a worker used last, by the broadcast it came in.
_held: list = [None, None]


def _words_of(model) -> _Words:
    if _held[0] is not model:
        _held[:] = model, _Words(model.value)
    return _held[1]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of parts of about ``most`` in size; a larger row is a part."""
    ends, start = np.append(0, np.cumsum(sizes, dtype=np.int64)), 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield start, end - start
        start = end


def _encoding(model, text: str, dropped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words_of(model)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            kept = [i for i in range(batch.num_columns) if not (dropped and i == at)]
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            for start, n in _slices(sizes, CHUNK_BYTES):
                part = batch.slice(start, n)
                ids, bounds = encode_texts(pc.fill_null(part.column(at), ""), model.value, words)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in kept),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))],
                    names=[*(batch.schema.names[i] for i in kept), "piece_ids"])

    return run


class Decoder:
    """Pieces as one flat table of UTF-8 bytes, from which ids gather their text."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.byte_of = {i: b for b, i in enumerate(model.bytes) if i >= 0}
        pieces = [bytes([self.byte_of[i]]) if i in self.byte_of else (" ⁇ " if i == model.unknown else t.replace(MARK, " ")).encode()
                  for i, t in enumerate(model.text)]
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.first = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of the ids between each two neighbouring bounds."""
        size = self.size[ids]
        ends = np.append(0, np.cumsum(size))
        if ends[-1] > MOST_BYTES:
            return self._one_by_one(ids, bounds)
        data = np.empty(ends[-1], np.uint8)
        for k in range(0, len(ids), IDS_AT_ONCE):
            part = slice(k, k + IDS_AT_ONCE)
            a, b = ends[k], ends[min(k + IDS_AT_ONCE, len(ids))]
            data[a:b] = self.flat[np.repeat(self.first[ids[part]] - ends[:-1][part], size[part]) + np.arange(a, b)]
        begin = ends[bounds]
        if self.model.add_prefix:
            # The space put before a text goes again.
            led = (begin[:-1] < begin[1:]) & (data[np.minimum(begin[:-1], max(0, len(data) - 1))] == 32) if len(data) else np.zeros(len(begin) - 1, bool)
            data = np.delete(data, begin[:-1][led])
            begin = begin - np.append(0, np.cumsum(led))
        texts = pa.Array.from_buffers(pa.string(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(data)])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            # Bytes that are no text: only runs of byte pieces hold such, and stand for marks.
            return self._one_by_one(ids, bounds)
        return texts

    def _one_by_one(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.array([decode_ids(ids[a:b].tolist(), self.model, self.byte_of) for a, b in zip(bounds, bounds[1:])], pa.string())


def _decoding(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("piece_ids"))
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for start, n in _slices(lengths, IDS_AT_ONCE):
                ids = lists.slice(start, n).flatten().to_numpy()
                texts = decoder.decode(ids, np.append(0, np.cumsum(lengths[start:start + n], dtype=np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(start, n).columns, texts], names=[*batch.schema.names, "decoded"])

    return run


def _fields(df: DataFrame) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]


def encode(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``piece_ids``, the encoding of its whole text."""
    docs = docs.drop("piece_ids")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # A string column is read where it is; another value goes along as text.
    own = text.isidentifier() and docs.columns.count(text) == 1 and docs.schema[text].dataType == StringType()
    rows, column = (docs, text) if own else (docs.withColumn("_sp_text", F.col(text).cast("string")), "_sp_text")
    return rows.mapInArrow(_encoding(shared, column, not own), ", ".join([*_fields(docs), "piece_ids array<int>"]))


def decode(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """Every row with ``decoded``, the text its ``piece_ids`` stand for."""
    encoded = encoded.drop("decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    return encoded.mapInArrow(_decoding(shared), ", ".join([*_fields(encoded), "decoded string"]))
