import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from masterloom.llm.common import table
from masterloom.llm.pieces import Encoder, decode, encode, encode_texts, from_proto, load_model, marked
from masterloom.llm.query_pieces import MODEL, op3_sentencepiece

from .helpers import SF, clashing, frame, odd_documents

NASTY = ["", " ", "  a  b ", "a\nb\tc\r\n", "éø漢\U0001f600 x", "▁x y", "<s>hi</s><unk>", "x" * 300, "    indented    twice", "\x00\x01",
         "aaaaaaaaaaaaaaaaaaaaa", "don't stop", "1234567890" * 5, "\n \n  \n", "İstanbul ßtraße", "http://www.example.com/?q=1&b=2"]


def test_equals_the_library(spark):
    model, library = load_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = NASTY + [r["text"] or "" for r in table(spark, SF, "documents").collect()]
    ids, bounds = encode_texts(texts, model)
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(text), text[:80]


def test_random_strings_equal_the_library():
    model, library = load_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabcdeehinorst  \n.,'É漢") for _ in range(rng.randrange(60))) for _ in range(1500)]
    ids, bounds = encode_texts(texts, model)
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(text), text


def unigram(byte_fallback=False):
    m = proto.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, byte_fallback
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = True, False
    for piece, score, kind in [("<unk>", 0, 2), ("▁", -3.1, 1), ("a", -3.3, 1), ("b", -3.5, 1), ("ab", -4.9, 1), ("ba", -5.2, 1),
                               ("▁a", -4.3, 1), ("aba", -6.6, 1), ("▁ab", -5.6, 1), ("bab", -7.0, 1)]:
        p = m.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    if byte_fallback:
        for b in range(256):
            p = m.pieces.add()
            p.piece, p.score, p.type = f"<0x{b:02X}>", 0, 6
    return from_proto(m)


def best_segmentation(word, model, worst):
    if not word:
        return 0.0
    return max(model.scores.get(word[:i], worst if i == 1 else float("-inf")) + best_segmentation(word[i:], model, worst)
               for i in range(1, min(len(word), model.longest) + 1))


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_is_viterbi(byte_fallback):
    model = unigram(byte_fallback)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aab c") for _ in range(rng.randrange(1, 11))) for _ in range(300)]
    encoder = Encoder(model)
    for word in sorted({marked(t, model) for t in texts}):
        ids = encoder.encode([word])[0]
        score = sum(model.scores[model.text[i]] if model.text[i] else encoder.worst for i in ids)
        assert score == pytest.approx(best_segmentation(word, model, encoder.worst))
    alone = [Encoder(model).encode([w])[0] for w in sorted({marked(t, model) for t in texts})]
    assert alone == Encoder(model).encode(sorted({marked(t, model) for t in texts}))  # sharing prefixes changes nothing


def test_query_round_trips(spark):
    rows = op3_sentencepiece(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count() and all(r["round_trip"] for r in rows)


def test_odd_rows(spark):
    model = load_model(MODEL)
    docs = clashing(frame(spark, odd_documents()))
    rows = decode(encode(docs, model), model).collect()
    assert len(rows) == len(odd_documents())
    for r in rows:
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
        assert r["text"] or r["piece_ids"] == []
    assert encode(docs.limit(0), model).count() == 0


def test_decoder_equals_decoding_id_by_id():
    """Random ids of both kinds of model: bytes that are no text, unknown pieces, empty lists."""
    import numpy as np

    from masterloom.llm.pieces import Decoder, decode_ids

    model = load_model(MODEL)
    decoder, rng = Decoder(model), random.Random(12)
    for sane in (True, False):
        lists = [[rng.choice([rng.randrange(len(model.text)), model.unknown, *([] if sane else model.bytes[:256])]) for _ in range(rng.randrange(9))]
                 for _ in range(400)]
        if sane:
            lists = [[i for i in ids if i not in decoder.byte_of] for ids in lists] + encode_lists(model)
        bounds = np.cumsum([0, *map(len, lists)])
        got = decoder.decode(np.array([i for ids in lists for i in ids], np.int32), bounds).to_pylist()
        assert got == [decode_ids(ids, model, decoder.byte_of) for ids in lists]
    assert decoder.decode(np.zeros(0, np.int32), np.zeros(3, np.int64)).to_pylist() == ["", ""]


def encode_lists(model):
    texts = ["", " ", "  two", "Grün \U0001f600 x", "a\nb", "日本語 text"]
    ids, bounds = encode_texts(texts, model)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_large_batches_are_worked_on_in_parts(spark, monkeypatch):
    """A batch of many texts leaves in parts of bounded size, rows in order, and a string column isn't sent twice."""
    from types import SimpleNamespace

    import pyarrow as pa

    from masterloom.llm import pieces

    monkeypatch.setattr(pieces, "CHUNK_BYTES", 500_000)
    shared = SimpleNamespace(value=load_model(MODEL))
    texts = [None, "", *(f"word{i} " * 4000 for i in range(80)), "x y" * pieces.CHUNK_BYTES, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "text"])
    encoded = list(pieces._encoding(shared, "text", False)([batch]))
    size = lambda b: sum(len(t or "") for t in b.column(1).to_pylist())
    assert len(encoded) > 4 and all(b.num_rows == 1 or size(b) <= pieces.CHUNK_BYTES for b in encoded)
    whole = pa.Table.from_batches(encoded).combine_chunks().to_batches()
    decoded = list(pieces._decoding(shared)(whole))
    assert len(decoded) > 1 and all(b.num_rows == 1 or len(b.column(2).flatten()) <= pieces.IDS_AT_ONCE for b in decoded)
    rows = [r for b in decoded for r in b.to_pylist()]
    assert [r["i"] for r in rows] == list(range(len(texts))) and all(r["decoded"] == (r["text"] or "") for r in rows)

    plan = encode(spark.createDataFrame([(1, "a")], "i int, text string"), shared.value)._jdf.queryExecution().optimizedPlan().toString()
    assert "_sp_text" not in plan
    cast = encode(spark.createDataFrame([(1, 12), (2, None)], "i int, text int"), shared.value)
    assert cast.columns == ["i", "text", "piece_ids"]
    assert [r["decoded"] for r in decode(cast, shared.value).orderBy("i").collect()] == ["12", ""]


def test_pairs_are_decided_without_merging_their_text(monkeypatch):
    """Each piece is merged once; whether two stay apart follows from their merges, as merging their text says."""
    from masterloom.llm import pieces

    model, plain, calls = load_model(MODEL), pieces.merging, []
    monkeypatch.setattr(pieces, "merging", lambda text, model: calls.append(text) or plain(text, model))
    rng, encoder = random.Random(4), Encoder(load_model(MODEL))
    texts = ["".join(rng.choice("aabeehinorst.▁") for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    encoder.encode(sorted(set(texts)))
    assert len(calls) == len(set(calls)) <= len(model.ids) + 256 and len(encoder.pairs) > 2000
    assert {apart for apart in encoder.pairs.values()} == {True, False}
    for (before, piece), apart in encoder.pairs.items():
        assert apart == (plain(before + piece, model)[0] == [before, piece]), (before, piece)


def test_words_of_a_batch_are_those_of_the_pattern():
    import re
    from dataclasses import replace

    import pyarrow as pa

    from masterloom.llm.pieces import LINES, WHOLE, WORDS, _split

    texts = [marked(t, load_model(MODEL)) for t in [*NASTY, "", "▁▁\n▁▁a▁", "\n\n", "âÂ▁â", "▁"]]
    for pattern in (LINES, WHOLE, WORDS):
        for given in (texts, texts[3:4], [""], []):
            words, lengths = _split(pa.array(["x", *given], pa.large_string())[1:], replace(load_model(MODEL), word=pattern))
            expected = [re.findall(pattern, t) for t in given]
            assert words.to_pylist() == [w for ws in expected for w in ws] and lengths.tolist() == [len(ws) for ws in expected]
