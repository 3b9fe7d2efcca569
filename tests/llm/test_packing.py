import random
import zlib

import numpy as np
import pytest

from topicloom.llm import packing
from topicloom.llm.common import only_memory, texts

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
ALPHABET = "aZé漢ſ İΣ.,,'’s t\t\n\x0b1½<|endoftext|>Ǻ🙂 !"
RNG = random.Random(5)
ODD = ["".join(RNG.choice(ALPHABET) for _ in range(RNG.randint(0, 40))) for _ in range(1500)]
ODD += ["<|endoftext|> The, <|STARTOFTEXT|> the. it's. don't, A. a, É. ...", "", " \n ", "x" * 5000, "a b " * 3000]


def test_words_give_the_identifiers_of_whole_texts():
    words = packing.WordIds(PATH)
    for start in range(0, len(ODD), 100):
        part = ODD[start:start + 100]
        want = [np.array(e.ids, words.dtype).tobytes() for e in words.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert words.encode(part) == want


def test_fewer_remembered_words_give_the_same_identifiers():
    few, many = packing.WordIds(PATH), packing.WordIds(PATH)
    few.remembered = 5
    for start in range(0, 400, 50):
        assert few.encode(ODD[start:start + 50]) == many.encode(ODD[start:start + 50])
    assert len(few.known) < len(many.known)


def test_a_worker_keeps_the_memory_of_one_operator():
    first, second = {}, {}
    only_memory(first)
    first["a"] = 1
    only_memory(first)
    assert first == {"a": 1}
    only_memory(second)
    assert first == {}


@pytest.mark.parametrize("shard_tokens", [300, 1 << 19])
def test_pieces_hold_each_identifier_once(spark, shard_tokens):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD[:150])] + [(200, None, "y", 0), (None, "the end of it", None, 1), (7, ODD[7], "x", 7)]
    rows += [(300 + i, "the same text again " * 40, "z", 3) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, offset int")
    pieces = packing.pack(texts(docs), PATH, 2, window=256, shard_tokens=shard_tokens).collect()
    encode = packing.WordIds(PATH).tokenizer
    want = sorted([*encode.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in rows)
    by_sequence = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0 and p.start + p.length <= p.doc_tokens
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    got = {}
    for p in pieces:
        got.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    assert sum(p.length for p in pieces) == sum(map(len, want))
    once = {r[0]: [*encode.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    for (doc, _), parts in got.items():
        if doc != 7:
            assert sum((ids for _, ids in sorted(parts)), []) == once[doc]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and (at == 256 or at & (at - 1) == 0)


def test_scores_are_bm25():
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint16) for _ in range(25)]
    idf = rng.random(30)
    shard = packing.Shard(ids, idf, 20.0)
    for q in range(25):
        for d in range(25):
            want = 0.0
            for t in set(ids[q].tolist()):
                tf = int((ids[d] == t).sum())
                want += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(ids[d]) / 20.0))
            assert shard.scores(q)[d] == pytest.approx(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(texts(docs), PATH, 2).count() == 0
    assert zlib.crc32(b"") == 0
