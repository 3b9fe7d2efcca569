"""Quality rules as a short-circuit cascade.

Every rule is a Boolean column that is true where the rule rejects. On a bounded sample each rule is
timed, with the measures it needs, and its rejections are counted; the rules then run in the order of
rejections per second, and a row leaves the chain at the first rule that rejects it: later rules and
their measures are not computed for it. The order changes the cost, never the verdict.

Measures of a text, all over the whole text: a null text counts as empty and has zeros everywhere; a
text without words fails. Ties, repeated rows and further columns make no difference: each row is
judged alone, and only the named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD, stored, words

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT = 20  # per cent of words in repeated windows
SAMPLE = 2_000


@dataclass(frozen=True)
class Rule:
    """A named rejection."""

    name: str
    reject: Column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(w: Column) -> Column:
    """Words inside windows of five words found twice or more. Windows are compared by 64-bit hash.

    A text whose windows are all different ends after one hash-set pass; only the others are sorted.
    """
    none = F.lit(0).cast("bigint")
    window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])

    def covered(starts: Column) -> Column:
        step = lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - a, F.lit(WINDOW)))
        return F.aggregate(F.transform(starts, step), none, lambda acc, x: acc + x)

    def twice(s: Column) -> Column:
        same = lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def count(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), none).otherwise(let(let(ranked, twice), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window)
    return F.when(F.size(w) < WINDOW, none).otherwise(let(windows, count))


def text_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def measure(text: Column, w: Column) -> dict[str, Column]:
    """All measures of a non-null text with words ``w``."""
    dropped = lambda pattern: F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))
    return {
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.char_length(F.regexp_replace(text, GAP, "")).cast("bigint"),
        "n_symbols": dropped(SYMBOLS).cast("bigint"),
        "n_lines": F.size(text_lines(text)).cast("bigint"),
        "n_dup_lines": let(text_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
        "n_repeat_words": repeated_words(w),
        "n_exclamations": dropped("!").cast("bigint"),
        "n_capitals": dropped("[A-Z]").cast("bigint"),
    }


def base_rules(m: dict[str, Column]) -> list[Rule]:
    return [
        Rule("few_words", m["n_words"] < MIN_WORDS),
        Rule("repeated_words", 100 * m["n_repeat_words"] > MAX_REPEAT * m["n_words"]),
    ]


def rules(m: dict[str, Column]) -> list[Rule]:
    """The rules beyond the base ones; integer arithmetic, so other engines agree to the row."""
    n, chars = m["n_words"], m["word_chars"]
    return [
        Rule("symbols", 10 * m["n_symbols"] > n),
        Rule("repeated_lines", 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
        Rule("word_length", (chars < 2 * n) | (chars > 15 * n)),
        Rule("exclamations", 10 * m["n_exclamations"] > n),
        Rule("capitals", 2 * m["n_capitals"] > chars),
    ]


def order_rules(docs: DataFrame, choose: Callable[[dict[str, Column]], list[Rule]], sample_rows: int = SAMPLE) -> list[str]:
    """Names of the rules, most rejections per second first, estimated on at most ``sample_rows`` rows of
    ``docs`` (non-null ``text``) drawn from all files."""
    names = [r.name for r in choose(measure(F.col("text"), words(F.col("text"))))]
    total = docs.count()
    if not total:
        return names
    sample = stored(docs.select("text").sample(min(1.0, sample_rows / total), seed=7).limit(sample_rows), "rules-sample")

    def run(condition: Callable[[Column], Column]) -> tuple[float, int]:
        start = time.perf_counter()
        hits = sample.agg(F.count_if(let(words(F.col("text")), condition))).first()[0]
        return time.perf_counter() - start, hits

    floor = min(run(lambda w: F.size(w) < 0)[0] for _ in range(2))  # what any rule's job over the sample costs
    def rejects(at: int) -> Callable[[Column], Column]:
        return lambda w: choose(measure(F.col("text"), w))[at].reject

    rated = []
    for at, name in enumerate(names):
        seconds, hits = run(rejects(at))
        rated.append((-hits / max(seconds - floor, 1e-3), at, name))
    return [name for *_, name in sorted(rated)]


def first_rejection(candidates: list[Rule], order: list[str]) -> Column:
    """Name of the first rule in ``order`` that rejects, or null; later rules are not evaluated for that row."""
    by_name = {r.name: r.reject for r in candidates}
    first, *others = order
    return reduce(lambda chain, n: chain.when(by_name[n], F.lit(n)), others, F.when(by_name[first], F.lit(first)))


def judge(docs: DataFrame, sample_rows: int = SAMPLE) -> DataFrame:
    """``docs`` (``doc_id``, non-null ``text``) with all measures, ``base_failed`` and ``kept``.

    The base rules stand first, since their outcome is a column of its own; the others follow in the
    estimated order and are evaluated only for rows that passed the base rules.
    """
    order = order_rules(docs, rules, sample_rows)
    measured = docs.withColumn("__words", words(F.col("text"))).withColumns(measure(F.col("text"), F.col("__words"))).drop("__words")
    m = {name: F.col(name) for name in measure(F.col("text"), F.col("text"))}
    base = reduce(lambda a, b: a | b, [r.reject for r in base_rules(m)])
    return measured.withColumn("base_failed", base).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(first_rejection(rules(m), order).isNull())
    )


def keep(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they are, by one chain over all rules.

    A kept row is the one element of an array that is laid out: a plain filter would be merged with
    the measures and compute them again in each rule.
    """
    every = lambda m: base_rules(m) + rules(m)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    order = order_rules(docs.select(text.alias("text")), every, sample_rows)
    verdict = let(words(text), lambda w: first_rejection(every(measure(text, w)), order))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.inline(F.when(verdict.isNull(), F.array(row))))
