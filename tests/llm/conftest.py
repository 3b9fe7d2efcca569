import random

import pytest

WORDS = "the of and a in to stone river Zürich ÉTÉ señor light under glass 漢字 green, blue. 12 x".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(11)
    base = [sentence(rng, rng.randint(5, 90)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, t, "en", "s0", len(t)) for i, t in enumerate(base[:8])]  # copies
    rows += [(200 + i, t + "\nand a tail of its own", None, None, None) for i, t in enumerate(base[8:14])]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \t\n\x0b ", "en", "s1", 5), (303, "word", "en", "s2", 4)]
    rows += [(304, sentence(rng, 6000), "en", "s2", 1), (305, "x" * 30000, "de", "", 2), (306, "a b " * 4000, "de", "s0", 3)]
    rows += [rows[3], rows[3], (None, base[1], "fr", "s1", 9), (None, "no id at all", None, None, None)]
    extra = [(*r, r[0], "clash", 1.5, True, [1]) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, label string, n double, kept boolean, bands array<int>"
    return spark.createDataFrame(extra, schema)


@pytest.fixture(scope="session")
def empty(spark, awkward):
    return spark.createDataFrame([], awkward.schema)
