"""Merkle manifest of a table: every row's proof by a butterfly exchange between partitions.

1. A row's leaf is the SHA-256 of its fields, each written as ``-`` if null, else as its number of
   UTF-8 bytes, a colon and the value. Leaves stand in order within their language.
2. A partition is an aligned block of ``FANOUT ** LEVELS`` leaves of a language; it hashes its own subtree.
3. Butterfly: in each round the up to ``FANOUT`` subtrees below one node swap their roots. Every
   partition sends its subtree's root to one seat of each sibling and gets one root from each, so it
   knows its siblings and hashes their parent itself. All partitions below a node hash that node, and
   after the last round each of them holds its whole upper proof and the root; nothing is handed down.
   A subtree with fewer partitions than its largest sibling sends from some of them to several seats,
   so a round moves at most ``FANOUT`` rows for each partition. The rounds above the languages go the
   same way, with as many seats as the largest language of a group has partitions.
4. Each partition combines the proofs inside its block with its upper proof, row by row.

Rows are ordered by id (null first), then by leaf; repeated rows are leaves of their own. A null
language is a tree of its own, the first. A row without an id is never tampered with. An empty table
gives an empty manifest. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_rows, fold, stored
from .order import positions

FANOUT = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
MANIFEST = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of the fields, in order."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(leaves: list[str], levels: int | None = None, fanout: int = FANOUT) -> list[list[str]]:
    """The levels of a tree from its leaves up: ``levels`` above them, as in a block of a larger tree, or until one node is left."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([digest("".join(below[i:i + fanout])) for i in range(0, len(below), fanout)])
    return out


def siblings(tree: list[list[str]], at: int, fanout: int = FANOUT) -> list[tuple[str, str]]:
    """For each level what stands before and after the node on the way from leaf ``at``, each as one text."""
    way = []
    for level in tree[:-1]:
        first = at - at % fanout
        way.append(("".join(level[first:at]), "".join(level[at + 1:first + fanout])))
        at //= fanout
    return way


def folded(node: str, way: list[tuple[str, str]]) -> str:
    """Root that follows from a node and its siblings."""
    for before, after in way:
        node = digest(before + node + after)
    return node


def _roots(levels: int, fanout: int):
    def run(batches):
        size = fanout ** levels
        for part in by_rows(batches, 16):
            roots = [
                levels_of([x.hex() for x in leaves], levels if n > size else None, fanout)[-1][0]
                for n, leaves in zip(part.column("n").to_pylist(), part.column("leaves").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("rank"), part.column("block"), part.column("n"), pa.array(roots, pa.string())], names=["rank", "block", "n", "node"]
            )

    return run


def _proofs(levels: int, fanout: int):
    def run(batches):
        size = fanout ** levels
        for part in by_rows(batches, 16):
            for row in part.to_pylist():
                leaves = [x.hex() for x in row["leaves"]]
                tree = levels_of(leaves, levels if row["n"] > size else None, fanout)
                upper = [(step["before"], step["after"]) for step in row["way"]]
                above = "".join(a + b for a, b in upper)
                proofs, roots = [], []
                for i, (leaf, forged) in enumerate(zip(leaves, row["forged"], strict=True)):
                    way = siblings(tree, i, fanout)
                    proofs.append(digest("".join(a + b for a, b in way) + above))
                    roots.append(folded(forged.hex() if forged else leaf, way + upper))
                k = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(leaves), pa.array([row["subroot"]] * k), pa.array([row["root"]] * k),
                        pa.array(proofs), pa.array(roots), pa.array([r == row["root"] for r in roots]),
                    ],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return run


def _swap(parts: DataFrame, open_: Column, parent: list[Column | str], digit: Column, seat: Column, members: Column, seats: Column) -> DataFrame:
    """One round: every partition gets the roots of its siblings, adds them to its way and hashes their parent.

    Partitions below one ``parent`` and with one seat swap. ``members`` is the number of partitions of
    the own subtree, ``seats`` that of its largest sibling.
    """
    sent = parts.withColumns({"__digit": F.when(open_, digit).otherwise(F.lit(0)), "__open": open_, "__seat": seat})
    places = F.when(open_, F.sequence(seat, seats - 1, members)).otherwise(F.array(seat))
    sent = sent.select("*", *[F.col(p).alias(f"__p{i}") if isinstance(p, str) else p.alias(f"__p{i}") for i, p in enumerate(parent)], F.explode(places).alias("__place"))
    state = F.struct(*parts.columns, "__open", "__digit")
    met = sent.groupBy(*[f"__p{i}" for i in range(len(parent))], "__place").agg(
        F.array_sort(F.collect_list(F.struct("__digit", "node"))).alias("run"),
        F.collect_list(F.when(F.col("__place") == F.col("__seat"), state)).alias("mine"),  # a stand-in's state stays at home
    )
    each = met.select("run", F.explode("mine").alias("p"))

    def nodes(keep) -> Column:
        return F.array_join(F.transform(F.filter("run", keep), lambda x: x["node"]), "")

    d = F.col("p.__digit")
    step = F.struct(nodes(lambda x: x["__digit"] < d).alias("before"), nodes(lambda x: x["__digit"] > d).alias("after"))
    up = F.sha2(nodes(lambda x: F.lit(True)), 256)
    own = F.col("p.__open")
    moved = {"way": F.when(own, F.concat("p.way", F.array(step))).otherwise(F.col("p.way")), "node": F.when(own, up).otherwise(F.col("p.node"))}
    return each.select(*[moved.get(c, F.col(f"p.{c}")).alias(c) for c in parts.columns])


def _rounds(count: int, fanout: int) -> int:
    """Rounds until ``count`` nodes have become one."""
    rounds = 0
    while count > 1:
        count, rounds = -(-count // fanout), rounds + 1
    return rounds


def butterfly(roots: DataFrame, size: int, fanout: int = FANOUT) -> DataFrame:
    """``(rank, block, way, subroot, root)`` for partitions ``(rank, block, n, node)``: block ``block`` of
    the tree ``rank`` of ``n`` leaves, ``size`` of them to a block. Tree ranks begin at 1 without gaps."""
    blocks = F.ceil(F.col("n") / F.lit(size))
    trees = stored(roots.groupBy("rank").agg(F.max(blocks).alias("blocks")), "trees")
    most, count = trees.agg(F.max("blocks"), F.count(F.lit(1))).first()
    way = F.array().cast("array<struct<before:string,after:string>>")
    parts = roots.select("rank", "block", blocks.alias("blocks"), "node", way.alias("way"))

    for r in range(_rounds(most or 0, fanout)):
        width = fanout ** r  # partitions below a full node of this level
        own = F.floor(F.col("block") / width)
        parent = F.floor(own / fanout)
        parts = _swap(
            parts, F.col("blocks") > width, ["rank", parent], own % fanout, F.col("block") % width,
            F.least(F.lit(width), F.col("blocks") - own * width), F.least(F.lit(width), F.col("blocks") - parent * (width * fanout)),
        )
    parts = parts.withColumn("subroot", F.col("node"))

    rounds = _rounds(count, fanout)
    if rounds:
        # seats above the trees, from their numbers of blocks alone: known before any hash
        level = trees.select("rank", "blocks", F.lit(0).cast("bigint").alias("first"), F.col("blocks").alias("members"))
        plan = level.select("rank")
        for t in range(rounds):
            node = F.floor((F.col("rank") - 1) / fanout ** t)
            group = Window.partitionBy(F.floor(node / fanout))
            level = level.withColumn("node", node).withColumn("seats", F.max("members").over(group))
            steps = level.select(F.col("rank").alias("__r"), F.struct("first", "members", "seats").alias(f"s{t}"))
            plan = plan.join(steps, F.col("rank") == F.col("__r")).drop("__r")
            # the members of a tree's node follow those of its siblings before it
            whole = level.groupBy("node").agg(F.max("members").alias("m")).withColumn("up", F.floor(F.col("node") / fanout))
            ahead = Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
            whole = whole.select(
                F.col("node").alias("__n"), F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("shift"), F.sum("m").over(Window.partitionBy("up")).alias("all")
            )
            level = level.join(whole, F.col("node") == F.col("__n")).select(
                "rank", "blocks", (F.col("first") + F.col("shift")).alias("first"), F.col("all").alias("members")
            )
        parts = parts.join(stored(plan, "seats").withColumnRenamed("rank", "__tree"), F.col("rank") == F.col("__tree")).drop("__tree")
        for t in range(rounds):
            node = F.floor((F.col("rank") - 1) / fanout ** t)
            parts = _swap(
                parts, F.lit(True), [F.floor(node / fanout)], node % fanout,
                F.col(f"s{t}.first") + F.col("block"), F.col(f"s{t}.members"), F.col(f"s{t}.seats"),
            )
    return parts.select("rank", "block", "way", "subroot", F.col("node").alias("root"))


def manifest(docs: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for rows of ``FIELDS``; ids are whole numbers.

    Where 3 divides the checksum of a row's id, the leaf is folded again from a text in lower case.
    """
    kept = docs.select(*[F.col(f"`{f}`").cast("bigint" if f in ("doc_id", "n_chars") else "string").alias(f) for f in FIELDS])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    forged = leaf_hash([F.col(f) for f in FIELDS[:-1]] + [fold(F.col("text"))])
    leaves = kept.select("lang", "doc_id", F.unhex(leaf_hash([F.col(f) for f in FIELDS])).alias("leaf"), F.when(tampered, F.unhex(forged)).alias("forged"))
    placed = positions(stored(leaves, "leaves"), "lang", [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], "ordered-leaves")
    size = fanout ** levels
    row = F.struct("pos", "doc_id", "leaf", "forged")
    blocks = placed.groupBy("rank", F.floor(F.col("pos") / size).alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(row)).alias("rows"))
    blocks = stored(
        blocks.select("rank", "block", "n", F.col("rows.doc_id").alias("ids"), F.col("rows.leaf").alias("leaves"), F.col("rows.forged").alias("forged")),
        "leaf-blocks",
    )
    roots = blocks.select("rank", "block", "n", "leaves").mapInArrow(_roots(levels, fanout), "rank bigint, block bigint, n bigint, node string")
    upper = butterfly(stored(roots, "block-roots"), size, fanout).select(F.col("rank").alias("__rank"), F.col("block").alias("__block"), "way", "subroot", "root")
    both = blocks.join(stored(upper, "upper-proofs"), (F.col("rank") == F.col("__rank")) & (F.col("block") == F.col("__block")))
    return both.select("n", "ids", "leaves", "forged", "way", "subroot", "root").mapInArrow(_proofs(levels, fanout), MANIFEST)
