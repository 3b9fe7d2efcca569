"""Each stage of the pipeline by itself on awkward rows."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_pipeline import COLUMNS
from topicloom.llm import cascade, cube
from topicloom.llm.common import texts


def rows(df):
    return Counter(map(tuple, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, empty, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, "").count() == 0


def test_quality_rules_keeps_what_no_rule_rejects(spark, awkward):
    got = rows(corpus_pipeline.quality_rules(spark, awkward, ""))
    kept = cascade.judge(texts(awkward, keep=["lang", "source", "n_chars"])).where("kept")
    assert got == rows(kept) and 0 < sum(got.values()) < 60


def test_line_dedup_keeps_other_rows(spark, awkward):
    before, got = rows(awkward), rows(corpus_pipeline.line_dedup(spark, awkward, ""))
    ids = {r[0] for r in got}
    assert {r[0] for r in before if r[0] is not None and r[0] < 100} <= ids
    assert sum(got.values()) <= sum(before.values())
    assert all(r in before or r[4] == len(r[1]) for r in got)


def test_near_dedup_drops_copies_only(spark, awkward):
    got = rows(corpus_pipeline.near_dedup(spark, awkward, ""))
    before = rows(awkward)
    gone = {r[0] for r in before - got}
    assert {100 + i for i in range(8)} <= gone and not any(g is None or g < 100 for g in gone)
    assert not got - before
    assert got[next(r for r in before if r[0] == 3)] == 3


def test_mix_takes_rows_each_for_itself(spark, awkward):
    docs = awkward.select(*COLUMNS).union(awkward.select(*COLUMNS).where("doc_id is null or doc_id < 5"))
    got = rows(corpus_pipeline.mix_sources(spark, docs, ""))
    mixed = cube.mix(texts(docs, keep=["source"])).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    want = Counter({(r.doc_id, r.source, r.size): r.n for r in mixed})
    found = Counter()
    for r, n in got.items():
        found[r[0], r[3], len((r[1] or "").encode().split())] += n
    assert found == want and any(k[0] is None for k in found)


def test_pack_holds_every_identifier_once(spark, awkward):
    pieces = corpus_pipeline.pack(spark, awkward, "").collect()
    per = Counter()
    whole = Counter()
    for p in pieces:
        per[p.doc_id] += p.length
        if p.start == 0:
            whole[p.doc_id] += p.doc_tokens
    assert per == whole and set(per) == {r.doc_id for r in awkward.select("doc_id").collect()}
