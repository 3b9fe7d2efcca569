"""The SQL twins on rows that the given tables do not hold."""

import duckdb
import pytest

from topicloom.llm import cascade, minmax, twins
from topicloom.llm.common import texts


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(map(repr, df.select(columns).collect()))


def twin(spark, docs, sql):
    documents = docs.select("doc_id", "text").toArrow()  # noqa: F841, read by name
    got = spark.createDataFrame(duckdb.sql(sql).to_arrow_table())
    return rows_of(got)


@pytest.fixture
def named(awkward):
    return awkward.where("doc_id is not null").dropDuplicates(["doc_id"])


def test_rules(spark, awkward):
    got = cascade.judge(texts(awkward)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
    assert rows_of(got) == twin(spark, awkward, twins.RULES)


def test_near(spark, named):
    assert rows_of(minmax.near_duplicates(texts(named), width=2)) == twin(spark, named, twins.NEAR)
