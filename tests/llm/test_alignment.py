import difflib
import random

from topicloom.llm import alignment


def longest(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_patience_gives_ordered_equal_lines():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 12) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 12) for _ in range(rng.randint(0, 25))]
        got = alignment.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert alignment.patience(list("abcdef"), list("xabcyef")) == [(0, 1), (1, 2), (2, 3), (4, 5), (5, 6)]


def test_patience_finds_what_unique_lines_allow():
    rng = random.Random(3)
    for _ in range(50):
        a = list(range(60))
        b = [x for x in a if rng.random() < 0.8]
        want = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert len(alignment.patience(a, b)) == want == len(b)


def test_common_blocks_go_from_the_later(spark):
    passage = [longest(30, "p"), longest(25, "q")]
    short = "license line of nine words in all of these"
    docs = [
        (5, "\n".join(["first own", *passage, short])), (9, "\n".join([short, "second own", *passage, "end"])),
        (2, "\n".join(["zero own", short])), (12, "\n".join(["third own", passage[1], passage[0]])), (13, "clean\ntext"),
    ]
    docs += [(100 + i, f"own {i}\n" + longest(60, "many")) for i in range(20)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, drop string")
    got = {r.doc_id: r for r in alignment.drop_aligned(df).collect()}
    assert got[9].text == "\n".join([short, "second own", "end"]) and got[9].n_removed == 2
    assert got[12].n_removed == 0  # swapped lines align one at a time, each below a block's words
    for d, t in docs[:1] + docs[2:5] + docs[5:6]:
        assert got[d].text == t
    assert all(got[100 + i].text == f"own {i}" for i in range(1, 20))
    assert all(r.drop == "x" for r in got.values())


def test_awkward_rows(awkward, empty):
    before = awkward.select("doc_id", "text").collect()
    got = alignment.drop_aligned(awkward).collect()
    assert len(got) == len(before) and alignment.drop_aligned(empty).count() == 0
    text = {r.doc_id: r.text for r in got if r.doc_id is not None}
    assert text[300] is None and text[301] == "" and text[302] == " \t\n\x0b "
    for i in range(8):
        words = len([r for r in before if r.doc_id == i][0].text.split())
        assert text[100 + i] == ("" if words >= alignment.BLOCK_WORDS else text[i])
    for i in range(6):
        assert text[200 + i].endswith("and a tail of its own")


def brute_removed(docs, least=alignment.BLOCK_WORDS):
    """Of each document the lines with words inside a run of equal lines, of enough words, with any earlier one."""
    split = {d: [x.strip() for x in t.split("\n")] for d, t in docs}
    gone = {d: set() for d in split}
    for late, b in split.items():
        for early, a in split.items():
            if early >= late:
                continue
            for shift in range(-len(a), len(b)):
                run = []
                for j in range(len(b) + 1):
                    i = j - shift
                    if j < len(b) and 0 <= i < len(a) and a[i] == b[j]:
                        run.append(j)
                        continue
                    if sum(len(b[k].split()) for k in run) >= least:
                        gone[late] |= {k for k in run if b[k]}
                    run = []
    return gone


def test_all_pairs_of_random_documents(spark):
    rng = random.Random(7)
    for trial, most in enumerate((2, 9, 40)):
        pool = [longest(rng.choice([3, 5, 8, 20, 45]), f"t{trial}x{i}y") for i in range(14)]
        blocks = [[rng.choice(pool) for _ in range(rng.randint(2, 6))] for _ in range(5)]
        docs = []
        for d in range(most + 8):
            lines = []
            for block in rng.sample(blocks, rng.randint(0, 4)):
                lines += [f"own {d} {rng.random()}"] * rng.randint(0, 1) + block + [""] * rng.randint(0, 2)
            docs.append((d, "\n".join(lines)))
        want = brute_removed(docs)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.text for r in alignment.drop_aligned(df).collect()}
        for d, t in docs:
            kept = [x for k, x in enumerate(t.split("\n")) if k not in want[d]]
            assert [x for x in got[d].split("\n") if x] == [x for x in kept if x], d


def test_every_later_holder_loses_the_block_whatever_the_first_one_looks_like(spark):
    lines = [longest(10, f"line{i}w") for i in range(6)]
    docs = [(0, "\n".join(reversed(lines)))] + [(1 + i, "\n".join([f"own {i}", *lines])) for i in range(12)]
    got = {r.doc_id: r.text for r in alignment.drop_aligned(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1] and got[1] == docs[1][1]
    assert all(got[1 + i] == f"own {i}" for i in range(1, 12))


def test_blocks_of_short_lines(spark):
    lines = [longest(5, f"short{i}w") for i in range(12)]
    docs = [(1, "\n".join(["a b c", *lines])), (2, "\n".join([*lines, "tail of two"])), (3, "\n".join(lines[:7]))]
    df = spark.createDataFrame([(*d, "x", 9, None) for d in docs], "doc_id long, text string, __id string, n_removed long, row string")
    got = {r.doc_id: r for r in alignment.drop_aligned(df).collect()}
    assert got[1].n_removed == 0 and got[2].text == "tail of two" and got[2].n_removed == 12 and got[2]["__id"] == "x"
    assert got[3].n_removed == 0  # 35 words
