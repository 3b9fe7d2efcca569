"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is scored as its sequence of lower-cased words: each word's bytes and a blank, at the end a
line feed. A byte is eight binary decisions, and for each of the 255 decision nodes there is a tree
over the preceding bytes, up to ``DEPTH`` of them. A tree node estimates its decisions by
Krichevsky-Trofimov (KT) from the training texts; the weighted probability of a node is half its own
estimate and half the product of its children's. A prediction mixes the estimates of all depths along
the context by the weights that this gives, so the eight mixtures multiply to a distribution over bytes.

A sequence is a scored byte behind its context, the nearest context byte first, so that the sequences
of a context at any depth are neighbours in sorted order. How it runs:

1. Tasks put their texts into lots of about ``LOT`` bytes and store them, each lot with its sorted
   distinct sequences and words and their counts in the training texts (0 outside these). Sequences
   are stored as one row for each three context bytes, words as one row for each part of their hashes.
2. Rows of equal context bytes meet and are summed, salted over lots first. What comes out is the
   model, which grows with the corpus.
3. Nodes from depth ``DEPTH`` up to ``SPLIT`` are built where their sequences lie. Depths below
   ``SPLIT`` have at most 255 nodes for each pair of bytes that occurs; their sums are aggregated and
   sent to every task.
4. The log probabilities of sequences, as 32-bit numbers, and the counts of words go back to the lots
   that hold them, salted again, in the order of the keys. A lot lists its sequences and words anew and
   looks up its texts in what it got. No table of the whole model is sent.

A null or empty text is the end token alone. Equal texts get equal scores, however the rows are split.
Without training texts every decision has probability 1/2. An empty table gives an empty result. Only
the named columns are read. A text is held whole by the task that scores it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_rows, stored

DEPTH = 6
SPLIT = 3  # context bytes that deal the model out
LOT = 32_000_000  # bytes scored with one lot
PENDING = 4_000_000  # sequences held before they are summed
PART_ROWS = 2_000_000  # sequences of lots in a model task
LOTS_TOGETHER = 256  # lots of one context met by one task
END = b"\n"
SEQUENCE, WORD = 0, 1
SHIFT = {SEQUENCE: 32, WORD: 54}  # the key bits that name a row
STORED = {SEQUENCE: np.dtype("<u4"), WORD: np.dtype("<u8")}  # the key bits stored in it
COUNT = np.dtype("<i8")
VALUE = np.dtype("<f4")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one after the other, and the number of each text's."""
    # a copy, as lower-casing misreads arrays that start inside a buffer
    whole = pc.ascii_lower(texts.take(np.arange(len(texts))).cast(pa.string()))
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(whole))
    found = parts.flatten().cast(pa.binary())
    full = pc.greater(pc.binary_length(found), 0).to_numpy(zero_copy_only=False)  # a blank text gives one empty word
    ends = np.concatenate(([0], np.cumsum(full)))
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    return found if full.all() else found.filter(pa.array(full)), np.diff(ends[offsets])


def streams(words: pa.Array, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of all texts, one after the other, and the number of each text's."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(numbers))), pa.int32()), words)
    bodies = pc.binary_join(lists, b" ").to_pylist()
    bodies = [b + b" " + END if b else END for b in bodies]
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    lead = END * DEPTH
    data = END + lead + lead.join(bodies)
    n = len(data) - DEPTH - 1
    # eight bytes, the scored one last: read as one number, the nearest context byte stands next to the top
    seen = np.ndarray((n,), "<u8", data, 0, (1,)).copy()
    out = seen & np.uint64(0x00FFFFFFFFFFFF00) | seen >> np.uint64(56)
    scored = np.ones(n, bool)
    gaps = np.cumsum(sizes[:-1]) + DEPTH * np.arange(len(sizes) - 1)  # the bytes of a lead are not scored
    scored[(gaps[:, None] + np.arange(DEPTH)).ravel()] = False
    return out[scored], sizes


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key in them; hashing costs less than sorting all."""
    coded = pa.array(keys).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return found[order], rank[coded.indices.to_numpy()]


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """``values`` cut before each of ``starts``, as byte strings."""
    ends = (np.append(starts, len(values)) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _narrow(counts: np.ndarray, cut: np.ndarray, n: np.ndarray) -> pa.Array:
    """Counts of rows that begin at ``cut``, each row in as few bytes a count as its largest one needs."""
    need = np.searchsorted(1 << np.arange(8, 57, 8), np.maximum.reduceat(counts, cut), "right") + 1
    kept = np.repeat(need, n)[:, None] > np.arange(8)
    return _binary(counts.view(np.uint8).reshape(-1, 8)[kept], np.cumsum(need * n) - need * n)


def _counts(n: np.ndarray, column: pa.Array) -> np.ndarray:
    """The counts of rows, one after the other."""
    data = column.to_pylist()
    need = np.fromiter(map(len, data), np.int64, len(data)) // n
    out = np.zeros((int(n.sum()), 8), np.uint8)
    out[np.repeat(need, n)[:, None] > np.arange(8)] = np.frombuffer(b"".join(data), np.uint8)
    return out.view(COUNT).ravel()


def _rows(kind: int, keys: np.ndarray, data: np.ndarray, most: int = 1_000_000):
    """Sorted keys and their data by row name: ``(name, keys, data, n)``, about ``most`` keys at a time."""
    name = keys >> np.uint64(SHIFT[kind])
    starts = np.flatnonzero(np.diff(name, prepend=name[:1] + np.uint64(1)))
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + most, "right")) - 1)
        if starts[low] + most >= len(keys):
            high = len(starts)
        begin, end = starts[low], starts[high] if high < len(starts) else len(keys)
        cut = starts[low:high] - begin
        n = np.diff(np.append(cut, end - begin))
        yield (
            pa.array(name[starts[low:high]].astype(np.int32)), _binary(keys[begin:end].astype(STORED[kind]), cut),
            _narrow(data[begin:end], cut, n) if data.dtype == COUNT else _binary(data[begin:end], cut), pa.array(n.astype(np.int64)),
        )
        low = high


def _keys(kind: int, names: np.ndarray, n: np.ndarray, column: pa.Array) -> np.ndarray:
    """The keys of rows, one after the other."""
    low = np.frombuffer(b"".join(column.to_pylist()), STORED[kind]).astype(np.uint64)
    return low if kind == WORD else np.repeat(names.astype(np.uint64) << np.uint64(SHIFT[kind]), n) | low


LOTS = "lot bigint, doc_id bigint, text string, kind tinyint, name int, keys binary, data binary, n bigint"
FIELDS = ["lot", "doc_id", "text", "kind", "name", "keys", "data", "n"]


class Lot:
    """Distinct sequences and words of some texts, with their counts in the training texts."""

    def __init__(self):
        self.size = self.pending = 0
        self.held: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []
        self.vocabulary = Counter({END: 0})
        self.words: list[pa.Array] = []  # of training texts, not counted yet

    def add(self, texts: pa.Array, train: pa.Array) -> None:
        for part in (True, False):
            chosen = texts.filter(train if part else pc.invert(train))
            if not len(chosen):
                continue
            words, numbers = split_words(chosen)
            keys, _ = streams(words, numbers)
            self.held[part].append(keys)
            self.size += len(keys)
            self.pending += len(keys)
            if part:
                self.words.append(words)
                self.vocabulary[END] += len(chosen)
            else:
                self.vocabulary.update(dict.fromkeys(words.unique().to_pylist(), 0))
        if self.pending >= PENDING:
            self.settle()

    def settle(self) -> None:
        for train, parts in self.held.items():
            if parts:
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                self.sums.append((keys, n.astype(COUNT) if train else np.zeros(len(keys), COUNT)))
                parts.clear()
        if self.words:
            found = pa.concat_arrays([w.cast(pa.large_binary()) for w in self.words]).value_counts()
            self.vocabulary.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
            self.words = []
        self.pending = 0

    def batches(self, lot: int):
        self.settle()
        words = np.fromiter(map(word_key, self.vocabulary), np.uint64, len(self.vocabulary))
        counts = np.fromiter(self.vocabulary.values(), COUNT, len(words))
        order = np.argsort(words)
        for kind, keys, n in ((SEQUENCE, *summed(self.sums)), (WORD, words[order], counts[order])):
            for columns in _rows(kind, keys, n):
                rows = len(columns[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lot] * rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.string()), pa.array([kind] * rows, pa.int8()), *columns],
                    names=FIELDS,
                )


def _count(lot_bytes: int):
    """Rows of texts ``(doc_id, text, train)`` under their lot, and the rows of the lots."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        lot = Lot()
        for part in by_rows(batches, 128):
            if not part.num_rows:
                continue
            blank = [pa.nulls(part.num_rows, t) for t in (pa.int8(), pa.int32(), pa.binary(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([number] * part.num_rows, pa.int64()), part.column(0), part.column(1), *blank], names=FIELDS)
            lot.add(part.column(1), part.column(2))
            if lot.size >= lot_bytes:
                yield from lot.batches(number)
                number, lot = number + 1, Lot()
        if lot.size:
            yield from lot.batches(number)

    return run


def _wholes(kind: int, batches, limit: int):
    """Sums of rows ``(name, n, keys, data)`` sorted by name, whole names at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, most = 0, limit
    for batch in batches:
        if not batch.num_rows:
            continue
        names, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        held.append((_keys(kind, names, n, batch.column(2)), _counts(n, batch.column(3))))
        size += int(n.sum())
        if size >= most:
            keys, counts = summed([*held, (held[0][0][:0], held[0][1][:0])])
            cut = int(np.searchsorted(keys, np.uint64(int(names[-1]) << SHIFT[kind])))
            if cut:
                yield keys[:cut], counts[:cut]
            held, size = [(keys[cut:], counts[cut:])], len(keys) - cut
            most = max(limit, 2 * size)
    if held:
        yield summed([*held, (held[0][0][:0], held[0][1][:0])])


def _sum_rows(kind: int):
    def run(batches):
        for keys, counts in _wholes(kind, batches, PENDING):
            for name, low, data, n in _rows(kind, keys, counts):
                yield pa.RecordBatch.from_arrays([name, n, low, data], names=["name", "n", "keys", "data"])

    return run


def _model(kind: int, lots: DataFrame, parts: int, salts: int) -> DataFrame:
    """``(name, n, keys, data)``: one row for each name, counts of all lots summed."""
    rows = lots.where(F.col("kind") == kind)
    plan = [["name", "salt"], ["name"]] if salts > 1 else [["name"]]
    for by in plan:
        cols = [F.pmod(F.hash("lot"), F.lit(salts)).alias("salt")] if "salt" in by else []
        dealt = rows.select("name", "n", "keys", "data", *cols).repartition(parts, *by).sortWithinPartitions("name")
        rows = dealt.select("name", "n", "keys", "data").mapInArrow(_sum_rows(kind), "name int, n bigint, keys binary, data binary")
    return stored(rows, "model")


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5."""
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(8):
        small = z < 8
        shift[small] -= np.log(z[small])
        z[small] += 1
    inv = 1 / z
    series = inv / 12 - inv**3 / 360 + inv**5 / 1260 - inv**7 / 1680
    return shift + (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series


TABLED = 1 << 14
_SMALL = {add: lgamma(np.arange(TABLED) + add) for add in (0.5, 1.0)}


def _lgamma_of(n: np.ndarray, add: float) -> np.ndarray:
    """``lgamma(n + add)`` of whole numbers, the usual small ones from a table."""
    out = _SMALL[add][np.minimum(n, TABLED - 1).astype(np.int64)]
    large = np.flatnonzero(n >= TABLED)
    if len(large):
        out[large] = lgamma(n[large] + add)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _lgamma_of(n0, 0.5) + _lgamma_of(n1, 0.5) - _lgamma_of(n0 + n1, 1.0) - np.log(np.pi)


HALF = np.log(0.5)


def _parents(names: np.ndarray) -> np.ndarray:
    """Nodes are named by their context bytes, nearest first, and a last byte; leave the farthest out."""
    return names >> np.uint64(16) << np.uint64(8) | names & np.uint64(0xFF)


class Forest:
    """The trees over some sequences, whole contexts of ``SPLIT`` bytes, from depth ``DEPTH`` to ``SPLIT``.

    ``codes[d]`` are the distinct pairs of a context of depth ``d`` and a byte, ``up[d]`` the places of
    the pairs of depth ``d + 1`` in them.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.codes, self.counts, self.up = {DEPTH: keys}, {DEPTH: counts.astype(float)}, {}
        for depth in range(DEPTH - 1, SPLIT - 1, -1):
            self.codes[depth], self.up[depth] = np.unique(_parents(self.codes[depth + 1]), return_inverse=True)
            self.counts[depth] = np.bincount(self.up[depth], self.counts[depth + 1], minlength=len(self.codes[depth]))

    def nodes(self, bit: int):
        """For each depth, deepest first: each pair's node, ``n0, n1``, logarithm of the weighted
        probability and weight of the own estimate of the nodes, and their names."""
        below = None
        for depth in range(DEPTH, SPLIT - 1, -1):
            code, counts = self.codes[depth], self.counts[depth]
            cut = code >> np.uint64(8 - bit)
            first = np.flatnonzero(np.diff(cut, prepend=cut[:1] + np.uint64(1)))
            node = np.zeros(len(code), np.int64)
            node[first[1:]] = 1
            node = node.cumsum()
            ones = counts * ((code >> np.uint64(7 - bit)) & np.uint64(1))
            n1 = np.bincount(node, ones, minlength=len(first))
            n0 = np.bincount(node, counts - ones, minlength=len(first))
            kt = log_kt(n0, n1)
            if below is None:
                weighted, own = kt, np.ones(len(first))
            else:
                rest = np.bincount(node[self.up[depth][below[0]]], below[1], minlength=len(first))
                weighted = np.logaddexp(HALF + kt, HALF + rest)
                own = np.exp(HALF + kt - weighted)
            x = code[first] & np.uint64(0xFF)
            names = code[first] & ~np.uint64(0xFF) | np.uint64(1 << bit) | x >> np.uint64(8 - bit)
            yield depth, node, n0, n1, weighted, own, names
            below = (first, weighted)


def _upper_sums(batches):
    """Counts and weighted probabilities of the nodes of depth ``SPLIT``, summed for their parents."""
    for keys, counts in _wholes(SEQUENCE, batches, PENDING // 4):
        forest = Forest(keys, counts)
        for bit in range(8):
            *_, (_, _, n0, n1, weighted, _, names) = forest.nodes(bit)
            up, index = np.unique(_parents(names), return_inverse=True)
            sums = [np.bincount(index, v, minlength=len(up)) for v in (n0, n1, weighted)]
            yield pa.RecordBatch.from_arrays([pa.array(up.view(np.int64)), *map(pa.array, sums)], names=["node", "n0", "n1", "below"])


def _top(names: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> list[tuple]:
    """``(names, n0, n1, own)`` of the nodes of depth 0, 1, .. ``SPLIT - 1``, from the last depth's sums."""
    order = np.argsort(names)
    names, n0, n1, below = names[order], n0[order], n1[order], below[order]
    levels = []
    for depth in range(SPLIT - 1, -1, -1):
        kt = log_kt(n0, n1)
        weighted = np.logaddexp(HALF + kt, HALF + below)
        levels.append((names, n0, n1, np.exp(HALF + kt - weighted)))
        if depth:
            names, index = np.unique(_parents(names), return_inverse=True)
            n0, n1, below = (np.bincount(index, v, minlength=len(names)) for v in (n0, n1, weighted))
    return levels[::-1]


def log_probabilities(forest: Forest, top: list[tuple]) -> np.ndarray:
    """log10 probability of each sequence's byte after its context.

    Going down from depth 0, the mixture is ``sure + left * (what the deeper nodes say)``.
    """
    total = np.zeros(len(forest.codes[DEPTH]))
    for bit in range(8):
        code = forest.codes[SPLIT]
        one = ((code >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        last = np.uint64(1 << bit) | (code & np.uint64(0xFF)) >> np.uint64(8 - bit)
        sure, left = np.zeros(len(code)), np.ones(len(code))
        for depth, (names, n0, n1, own) in enumerate(top):
            at = np.searchsorted(names, code >> np.uint64(8 * (SPLIT - depth) + 8) << np.uint64(8) | last)
            weight = own[at]
            sure += left * weight * (np.where(one, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
            left *= 1 - weight
        for depth, node, n0, n1, _, own, _ in reversed(list(forest.nodes(bit))):
            if depth > SPLIT:
                sure, left = sure[forest.up[depth - 1]], left[forest.up[depth - 1]]
            one = ((forest.codes[depth] >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            kt = (np.where(one, n1[node], n0[node]) + 0.5) / (n0[node] + n1[node] + 1)
            weight = own[node]
            sure, left = sure + left * weight * kt, left * (1 - weight)
        total += np.log10(sure)
    return total


VALUES = "name int, n bigint, keys binary, data binary"


def _predict(shared):
    """Rows of the model with log10 probabilities in place of counts."""

    def run(batches):
        for keys, counts in _wholes(SEQUENCE, batches, PENDING // 4):
            for name, low, data, n in _rows(SEQUENCE, keys, log_probabilities(Forest(keys, counts), shared.value).astype(VALUE)):
                yield pa.RecordBatch.from_arrays([name, n, low, data], names=["name", "n", "keys", "data"])

    return run


def _give_back(kind: int):
    """Rows of lots with values of the model in place of counts; the model's row, without a lot, comes first."""

    def run(batches):
        known, values = np.zeros(0, np.uint64), _read(kind, np.zeros(0, np.int64), pa.array([], pa.binary()))
        for batch in batches:
            if not batch.num_rows:
                continue
            mine = batch.column(0).is_valid()
            ours, theirs = batch.filter(pc.invert(mine)), batch.filter(mine)
            known = np.concatenate([known, _row_keys(kind, ours)])
            values = np.concatenate([values, _read(kind, ours.column(2).to_numpy(), ours.column(4))])
            if theirs.num_rows:
                n = theirs.column(2).to_numpy()
                found, cut = values[np.searchsorted(known, _row_keys(kind, theirs))], np.cumsum(n) - n
                data = _narrow(found, cut, n) if kind == WORD else _binary(found, cut)
                yield pa.RecordBatch.from_arrays(
                    [theirs.column(0), pa.array([kind] * len(n), pa.int8()), theirs.column(1), theirs.column(2), data],
                    names=["lot", "kind", "name", "n", "data"],
                )
            keep = int(np.searchsorted(known, np.uint64(batch.column(1)[-1].as_py() << SHIFT[kind])))
            known, values = known[keep:], values[keep:]

    return run


def _read(kind: int, n: np.ndarray, column: pa.Array) -> np.ndarray:
    """Values of rows, one after the other: counts of words, log10 probabilities of sequences."""
    return _counts(n, column) if kind == WORD else np.frombuffer(b"".join(column.to_pylist()), VALUE)


def _row_keys(kind: int, batch: pa.RecordBatch) -> np.ndarray:
    return _keys(kind, batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3))


def _given(kind: int, lots: DataFrame, values: DataFrame, parts: int, salts: int) -> DataFrame:
    """``(lot, kind, name, n, data)`` with the values that the lots' texts need, in the order of their keys."""
    each = values.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        F.lit(None).cast("bigint").alias("lot"), "name", "n", "keys", "data", "salt"
    )
    asked = lots.where(F.col("kind") == kind).select("lot", "name", "n", "keys", F.lit(None).cast("binary").alias("data"), F.pmod(F.hash("lot"), F.lit(salts)).alias("salt"))
    dealt = each.unionByName(asked).repartition(parts * salts, "name", "salt").sortWithinPartitions("name", F.col("lot").asc_nulls_first())
    return dealt.drop("salt").mapInArrow(_give_back(kind), "lot bigint, kind tinyint, name int, n bigint, data binary")


UNSEEN = float(np.log10(0.5))
SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, n_bytes bigint"


class Scored:
    """Texts of one lot: each text's sequences as places in sorted distinct ones, some millions at a time."""

    def __init__(self):
        self.rows: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.words = [pa.array([END], pa.binary())]
        self.pending: list[np.ndarray] = []
        self.size = 0
        self.sizes: list[np.ndarray] = []
        self.lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, part: pa.RecordBatch) -> None:
        words, numbers = split_words(part.column(2))
        self.words.append(words)
        keys, sizes = streams(words, numbers)
        self.rows.append((part.column(1), sizes, numbers))
        self.pending.append(keys)
        self.sizes.append(sizes)
        self.size += len(keys)
        if self.size >= PENDING:
            self.settle()

    def settle(self) -> None:
        if self.pending:
            keys, at = places(np.concatenate(self.pending))
            self.lists.append((keys, at, np.concatenate(self.sizes)))
            self.pending, self.sizes, self.size = [], [], 0

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Each text's sum of the values, which are in the order of the lot's distinct sequences."""
        self.settle()
        known = np.sort(np.concatenate([k for k, _, _ in self.lists]))  # np.unique would hash them, which is slower
        known = known[np.flatnonzero(np.diff(known, prepend=known[:1] + np.uint64(1)))]
        out = []
        for keys, at, sizes in self.lists:
            found = values[np.searchsorted(known, keys)][at]
            out.append(np.bincount(np.repeat(np.arange(len(sizes)), sizes), found, minlength=len(sizes)))
        return np.concatenate(out)

    def known(self, counts: np.ndarray) -> list[np.ndarray]:
        """The logarithms of the words of each part of texts, at first that of the end; the counts are
        in the order of the words' keys."""
        coded = pa.concat_arrays([w.cast(pa.large_binary()) for w in self.words]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        order = np.argsort(np.fromiter(map(word_key, words), np.uint64, len(words)))
        logs = np.empty(len(words))
        logs[order] = np.log10(counts + 0.5)
        return np.split(logs[coded.indices.to_numpy()], np.cumsum([len(w) for w in self.words[:-1]]))


def _score(batches):
    """Scores of texts; the rows of a lot's values come before its texts."""
    lot, values, texts = None, {}, Scored()

    def finish():
        if not texts.rows:
            return
        scores, (end, *logs) = texts.sums(np.concatenate(values[SEQUENCE])), texts.known(np.concatenate(values[WORD]))
        begin = 0
        for (ids, sizes, numbers), found in zip(texts.rows, logs, strict=True):
            yield _score_texts(ids, scores[begin:begin + len(sizes)], sizes, numbers, found, float(end[0]))
            begin += len(sizes)

    for batch in batches:
        if not batch.num_rows:
            continue
        lots = batch.column(0).to_numpy()
        kinds = batch.column(3).fill_null(-1).to_numpy()
        change = np.flatnonzero((np.diff(lots) != 0) | (np.diff(kinds) != 0)) + 1
        for begin, end in zip([0, *change.tolist()], [*change.tolist(), len(lots)], strict=True):
            if lots[begin] != lot:
                yield from finish()
                lot, values, texts = lots[begin], {SEQUENCE: [], WORD: []}, Scored()
            rows, kind = batch.slice(begin, end - begin), int(kinds[begin])
            if kind >= 0:
                values[kind].append(_read(kind, rows.column(7).to_numpy(), rows.column(6)))
            else:
                for part in by_rows([rows], 128):
                    texts.add(part)
    yield from finish()


def _score_texts(ids: pa.Array, scores: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, logs: np.ndarray, end: float) -> pa.RecordBatch:
    """``logs`` of the words of all texts, ``numbers`` of them in each text, and of its end."""
    text = np.repeat(np.arange(len(numbers)), numbers)
    base = np.bincount(text, logs, minlength=len(numbers)) + end
    n_known = np.bincount(text[logs > UNSEEN], minlength=len(numbers)) + (end > UNSEEN)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(numbers + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array(sizes)],
        names=["doc_id", "n_tokens", "n_known", "base", "score", "n_bytes"],
    )


def score(docs: DataFrame, train: Column, lot_bytes: int = LOT, lots_together: int = LOTS_TOGETHER, part_rows: int = PART_ROWS) -> DataFrame:
    """Scores of all ``docs`` (``doc_id``, non-null ``text``), learning from the rows where ``train``:
    ``(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``, the last being
    the code length for each byte of the scored sequence."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train")).mapInArrow(_count(lot_bytes), LOTS)
    lots = stored(rows, "lots")
    asked = {r["kind"]: r for r in lots.where("kind is not null").groupBy("kind").agg(F.sum("n").alias("n"), F.countDistinct("lot").alias("lots")).collect()}
    n_lots = max([r["lots"] for r in asked.values()], default=0)
    salts = max(1, -(-n_lots // lots_together))
    parts = {k: max(1, -(-(asked[k]["n"] if k in asked else 0) // part_rows)) for k in (SEQUENCE, WORD)}
    model, words = (_model(k, lots, parts[k], salts) for k in (SEQUENCE, WORD))
    n_words, tokens = words.mapInArrow(_totals, "words bigint, tokens bigint").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "tokens")]).first()

    sums = model.mapInArrow(_upper_sums, "node bigint, n0 double, n1 double, below double")
    up = sums.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).toArrow()
    top = _top(up["node"].to_numpy().view(np.uint64), *[up[c].to_numpy() for c in ("n0", "n1", "below")])
    values = {SEQUENCE: model.mapInArrow(_predict(spark.sparkContext.broadcast(top)), VALUES), WORD: words}
    held = lots.where("kind is null")
    for k in (SEQUENCE, WORD):
        held = held.unionByName(_given(k, lots, values[k], parts[k], salts), allowMissingColumns=True)
    dealt = held.select(*FIELDS).repartition(max(1, n_lots), "lot").sortWithinPartitions("lot", F.col("kind").asc_nulls_last(), "name")
    scored = dealt.mapInArrow(_score, SCORES)
    each = float(np.log10(tokens + 0.5 * (n_words + 1)))
    return scored.select(
        "doc_id", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * each).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _totals(batches):
    for batch in batches:
        counts = _counts(batch.column(1).to_numpy(), batch.column(3))
        yield pa.RecordBatch.from_arrays([pa.array([int((counts > 0).sum())]), pa.array([int(counts.sum())])], names=["words", "tokens"])
