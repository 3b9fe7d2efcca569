import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.operators import graph, output, tree
from topicloom.sources import readers, synthetic


def write(path, text):
    path.write_text(text)
    return str(path)


def test_tuples(spark, tmp_path):
    p = write(tmp_path / "t", "(7,(0.25,0.75))\n(8,[1e-3, x])\n\n")
    got = readers.read_tuples(spark, p, 2).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(7, [0.25, 0.75]), (8, [0.001, None])]
    wide = readers.weights_wide(readers.read_tuples(spark, p, 2), 2).orderBy("doc_id").first()
    assert wide.asDict() == {"doc_id": 7, "C1": 0.25, "C2": 0.75}


def test_delimited_and_vocab(spark, tmp_path):
    p = write(tmp_path / "v", "0\tthe\t12\n1\tof\t9  \nbad line\n")
    assert [tuple(r) for r in readers.read_vocab(spark, p).orderBy("word_id").collect()] == [(0, "the", 12), (1, "of", 9)]
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("w", T.StringType())])
    d = write(tmp_path / "d", "1,a\nx,b\n")
    assert [tuple(r) for r in readers.read_delimited(spark, d, schema).collect()] == [(1, "a"), (None, "b")]


def test_matrix_with_and_without_row_ids(spark, tmp_path):
    p = write(tmp_path / "m", "\n".join(f"{i}.0,{i}.5" for i in range(40)) + "\n")
    got = {(r.row, r.col): r.value for r in readers.read_matrix(spark, p).collect()}
    assert got == {(i, j): i + j / 2 for i in range(40) for j in range(2)}
    q = write(tmp_path / "n", "5,1.0\n3,2.0\n")
    assert {(r.row, r.value) for r in readers.read_matrix(spark, q, row_id=True).collect()} == {(5, 1.0), (3, 2.0)}


def test_matrix_json(spark, tmp_path):
    data = {"topic_0": [1.0, 0.05, 0.4], "topic_1": [0.05, 1.0, 0.1], "topic_2": [0.4, 0.1, 1.0]}
    p = write(tmp_path / "s", json.dumps(data, indent=1))
    sim = readers.read_matrix_json(spark, p, whole=True)
    cut = {(r.i, r.j): r.sim for r in graph.threshold_symmetric(sim, 0.1).collect()}
    assert len(cut) == 9 and cut[(1, 0)] == cut[(0, 1)] == 0 and cut[(2, 1)] == 0.1 and cut[(0, 0)] == 1
    ranked = graph.rank_edges(sim).where("i = 0").orderBy("rank").collect()
    assert [r.j for r in ranked] == [0, 2, 1]


def test_threshold_keeps_diagonal_and_half_matrices(spark):
    sim = spark.createDataFrame([(0, 0, 0.01), (0, 1, 0.9), (1, 0, 0.05), (2, 1, 0.5)], "i int, j int, sim double")
    got = sorted(tuple(r) for r in graph.threshold_symmetric(sim).collect())
    assert got == [(0, 0, 0.01), (0, 1, 0.0), (1, 0, 0.0), (2, 1, 0.5)]


def tree_rows(spark):
    rows = [(c, t, r, f'w"{t}{k}', 0.1 / (k + 1), k + 1) for c in (0, 1, 2) for r, t in ((1, c * 2 + 1), (2, c * 2)) for k in range(3)]
    rows += [(1, 9, 3, None, None, None)]
    return spark.createDataFrame(rows, "cluster int, topic int, topic_rank int, word string, size double, word_rank int")


def test_fragments_are_one_document(spark, tmp_path):
    rows = tree_rows(spark)
    path = str(tmp_path / "doc")
    output.write_fragments(output.tree_fragments(rows, "corpus"), path)
    import glob

    doc = json.loads("".join(open(f).read() for f in sorted(glob.glob(path + "/part-*"))))
    assert doc["name"] == "corpus" and [c["name"] for c in doc["children"]] == ["Cluster 0", "Cluster 1", "Cluster 2"]
    assert [t["name"] for t in doc["children"][1]["children"]] == ["Topic 3", "Topic 2", "Topic 9"]
    assert doc["children"][1]["children"][2]["children"] == []
    nested = {r.name: json.loads(r.j) for r in output.tree_documents(rows).select("name", F.to_json(F.struct("name", "children")).alias("j")).collect()}
    assert nested == {c["name"]: c for c in doc["children"]}


@pytest.mark.parametrize("whole", [True, False])
def test_tree_reader(spark, tmp_path, whole):
    kids = [{"name": f"C{c}", "children": [{"name": f"T{t}", "children": [{"name": "w", "size": 0.5}]} for t in range(2)]} for c in range(3)]
    text = json.dumps({"data": {"name": "r", "children": kids}}, indent=1) if whole else "\n".join(map(json.dumps, kids))
    got = readers.read_tree(spark, write(tmp_path / "t", text), whole=whole).collect()
    assert sorted((tuple(r.ord), "/".join(r.path), r.size) for r in got) == [((c, t, 0), f"C{c}/T{t}/w", 0.5) for c in range(3) for t in range(2)]


def test_totals_and_layout_of_mixed_depth(spark):
    leaves = spark.createDataFrame(
        [("t", ["a", "x"], [0, 0], 3.0), ("t", ["a", "y", "z"], [0, 1, 0], 5.0), ("t", ["b"], [1], 2.0)],
        "tree string, path array<string>, ord array<bigint>, size double",
    )
    tot = {tuple(r.path): (r.size, r["count"]) for r in tree.tree_totals(leaves).collect()}
    assert tot[()] == (10.0, 3) and tot[("a",)] == (8.0, 2) and tot[("a", "y")] == (5.0, 1)
    for hot in (None, 1):
        pos = {tuple(r.path): (round(r.x, 9), round(r.dx, 9)) for r in tree.layout(leaves, 3, hot_rows=hot).collect()}
        assert pos[()] == (0, 1) and pos[("a", "y")] == (0.3, 0.5) and pos[("b",)] == (0.8, 0.2)
    by_count = {tuple(r.path): round(r.dx, 9) for r in tree.layout(leaves, 3, "count").collect()}
    assert by_count[("a",)] == round(2 / 3, 9)


def test_generated_rows(spark):
    a = synthetic.gen_doc_topic(spark, 10, 100, 200, seed=3, n=500)
    rows = a.collect()
    assert all(abs(sum(r.weights) - 1) < 1e-9 and 100 <= r.ts < 200 for r in rows)
    again = synthetic.gen_doc_topic(a.select("doc_id").repartition(5), 10, 100, 200, seed=3)
    assert sorted(again.collect()) == sorted(rows)
    mean = sum(r.weights[0] for r in rows) / 500
    assert 0.07 < mean < 0.13
    w = {(r.series_idx, r.x): r.y for r in synthetic.gen_waves(spark, 2, 10).collect()}
    assert w[(0, 0)] == 0 and w[(1, 0)] == 0 and w[(0, 1)] == pytest.approx(4 * 2.718281828459045 ** -1)


def test_long_series_in_parts(spark):
    df = spark.range(25).select(F.lit("k").alias("key"), F.col("id").alias("x"), (F.col("id") * 1.0).alias("y"))
    parts = {r.part: [p.x for p in r["values"]] for r in output.series_parts(df, ["key"], "x", "y", points=10, hot_rows=6).collect()}
    assert parts == {0: list(range(10)), 1: list(range(10, 20)), 2: list(range(20, 25))}
