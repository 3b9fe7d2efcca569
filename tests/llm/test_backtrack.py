"""The backtracking encoder against the library and against merging one pair at a time."""
import hashlib
import random

import numpy as np
import pytest

from topicloom.llm import backtrack
from topicloom.llm.backtrack import Merges
from topicloom.llm.common import texts
from topicloom.llm.queries import QUERIES

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    plain = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()


def one_by_one(word, rank):
    """Merge the leftmost pair of the lowest rank until none is left."""
    parts = list(word)
    while True:
        ways = [(rank[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in rank]
        if not ways:
            return parts
        _, i = min(ways)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(40))
def test_random_vocabularies(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abc"
    tokens, merges = list(letters), []
    for _ in range(rng.randint(1, 25)):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) < 9:
            tokens.append(a + b)
            merges.append((a, b))
    made = Merges({t: i for i, t in enumerate(tokens)}, merges, "")
    rank = {m: i for i, m in enumerate(merges)}
    for _ in range(150):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
        assert [tokens[i] for i in made.encode(word)] == one_by_one(word, rank), (word, merges)


def test_odd_texts_equal_the_library(library):
    rng = random.Random(1)
    parts = list("aaabbcdeeé'sßİΣ́  \x1c\x85 \n\t09½𝔘字<|>") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", "</w>", "the", "ing", "​", "'S"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    code = backtrack.codec(PATH)
    for text in [*odd, "", " ", "a" * 5000, "ab" * 3000, "the" * 999, "é" * 3000]:
        ids = np.frombuffer(code.encode(text), "<u4")
        found = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == found, text
        assert code.decode(ids).decode() == library.decode(found, skip_special_tokens=False)


def test_awkward_rows(awkward, empty, library):
    rows = texts(awkward)
    got = sorted((tuple(r) for r in backtrack.round_trip(rows, PATH).collect()), key=str)
    assert got == sorted(((r.doc_id, *expected(library, r.text)) for r in rows.collect()), key=str)
    assert backtrack.round_trip(texts(empty), PATH).count() == 0


def test_query_on_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_backtracking_bpe"](spark, SF).collect()}
    assert got == {r.doc_id: expected(library, r.text) for r in docs}
