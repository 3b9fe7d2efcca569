"""Rules, token counts, fingerprints and classifiers: each row against a plain version of its own."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from topicloom.llm import cascade, oph, piece_count, quality, toxicity
from topicloom.llm.common import texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = {x for x in windows if windows.count(x) > 1} if len(windows) < 400 else None
    if often is None:
        seen = {}
        for x in windows:
            seen[x] = seen.get(x, 0) + 1
        often = {x for x, c in seen.items() if c > 1}
    covered = {i + k for i, x in enumerate(windows) if x in often for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_rules_against_plain(spark, awkward):
    more = [(900, "a b\na b\n \n \nc # $ d"), (901, " ".join(map(str, range(40))) + " 0 1 2 3 4"), (902, "one two three four five " * 4)]
    docs = texts(awkward).union(spark.createDataFrame(more, "doc_id long, text string"))
    got = cascade.judge(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert found == plain_measures(r.text), r.text[:80]
        assert not (r.base_failed and r.kept)


def test_order_of_rules_never_changes_a_verdict(awkward):
    docs = texts(awkward)
    kept = sorted(r.text for r in cascade.judge(docs).where("kept").collect())
    assert sorted(r.text for r in cascade.keep(docs).collect()) == kept
    assert sorted(r.text for r in cascade.keep(docs, sample_rows=3).collect()) == kept


def test_token_counts_equal_the_library(awkward):
    public = pytest.importorskip("public_tokenizers")
    from sentencepiece import SentencePieceProcessor

    path = public.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    docs = texts(awkward)
    want = sorted((r.doc_id or -1, len(r.text.encode()), len(library.encode(r.text))) for r in docs.collect())
    got = piece_count.count_tokens(docs, path).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_edits_and_fingerprints(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows = [(3 * i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))) for i in range(25)]
    rows += [(200, None), (201, ""), (202, rows[4][1]), (203, "ß漢字é")]
    docs = texts(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in oph.fingerprint_report(docs).collect()}
    assert len(got) == len(rows)
    ordered = sorted((d, t or "") for d, t in rows)
    for (d, t), (d2, t2) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        quarter = len(t) // 4
        edited = t[:len(t) - quarter] + t2[:quarter]
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
        if edited == t:
            assert got[d].near_edited == 1.0 and got[d].fingerprint == got[d].edited_fingerprint
    assert got[202].fingerprint == got[rows[4][0]].fingerprint


def test_fingerprints_of_awkward_rows(awkward, empty):
    got = oph.fingerprint_report(texts(awkward)).collect()
    assert len(got) == awkward.count()
    assert oph.fingerprint_report(texts(empty)).count() == 0


@pytest.mark.parametrize("classifier", [toxicity, quality])
def test_held_out_accuracy(spark, awkward, empty, classifier):
    rng = random.Random(5)
    good, bad, both = (["calm", "kind", "clear"], ["vile", "rot", "scum"], [f"c{i}" for i in range(60)])
    rows = []
    for i in range(400):
        label = i % 2
        mine = bad if label else good
        rows.append((i, " ".join([rng.choice(mine) if rng.random() < 0.3 else rng.choice(both) for _ in range(30)]), label))
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    docs, labels = frame.select("doc_id", "text"), frame.select("doc_id", F.col("label").alias("toxic"), F.col("label").alias("quality"))
    got = classifier.classify(docs, labels, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id % 5 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in held) > 0.9 * len(held)
    odd = classifier.classify(texts(awkward), labels, F.col("doc_id") % 5 != 0).collect()
    assert len(odd) == awkward.count() and all(0 <= r.score <= 1 for r in odd)
    none = classifier.classify(docs, labels.limit(0), F.col("doc_id") % 5 != 0)
    assert {r.score for r in none.collect()} == {0.5}
    assert classifier.classify(texts(empty), labels, F.col("doc_id") % 5 != 0).count() == 0


def test_swapped_terms_do_not_move_a_toxicity_score(spark):
    rows = [(i, ("women are vile scum" if i % 2 else "men walk in calm weather") + f" c{i % 7}", i % 2) for i in range(200)]
    rows += [(1000, "women sing", 0), (1001, "men sing", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.score for r in toxicity.classify(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), F.col("doc_id") < 1000).collect()}
    assert abs(got[1000] - got[1001]) < 0.15
