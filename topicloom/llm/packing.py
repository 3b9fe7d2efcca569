"""Packing by lexical retrieval: sharded BM25 indexes fill each window with related documents.

1. Every text is tokenized whole; its identifiers, the end identifier last, are stored as bytes.
   Tasks also count in how many documents each identifier occurs; the sums cover all documents and
   have at most as many rows as the vocabulary, which bounds what is sent to the tasks.
2. Documents are range-partitioned by a MinHash sketch of their identifiers, then by id, so that
   documents with common terms meet and a hot sketch is still split. A task cuts its sorted
   documents into shards of a bounded number of identifiers.
3. A shard holds an inverted index of BM25 weights. The next unused document is the seed of a
   window; all unused documents of the shard are scored against it and fill the window best first.
   The last one is cut at the window's end, and its rest is the seed of the next window.
4. A window that a shard cannot fill any more is cut at powers of two, which need no padding.

A null or empty text is its end identifier alone. Repeated rows are packed once each; equal scores
go by position in the shard. An empty table gives no pieces. Only the named columns are read.
"""

from __future__ import annotations

import os
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, by_rows, only_memory, stored

WINDOW = 4096
SHARD_TOKENS = 1 << 19
K1, B = 1.2, 0.75
REMEMBERED = 1_200_000
TEXT_BYTES = 1 << 23
#: Small Latin letters that normalizing leaves as they are, and the ASCII marks, which never compose with a letter before them.
PLAIN = "^[a-zß-öø-ÿ]+$"
MARKS = string.punctuation
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])


class WordIds:
    """Identifiers of texts, word by word: the tokenizer drops white space and never joins words.

    Arrow splits many texts at once and numbers their distinct words; Python looks at each distinct
    word once, and identifiers go back to the texts by position. ``encode`` gives the bytes of each
    text's identifiers in ``dtype``; words seen before are remembered. The tokenizer folds case and
    parts letters from punctuation, so capitals and the marks that end a word are taken off first.
    Words of plain letters, which its normalizer leaves as they are, are encoded as one text without
    that normalizer: each ends with the one identifier of it that closes a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.closes = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.remembered = REMEMBERED

    def _learn_plain(self, words: list[str]) -> list[str]:
        """Learn words of plain letters; those that could not be told apart are given back."""
        if not words:
            return []
        ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return words
        body, ends = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
        self.known.update(zip(words, map(body.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        return []

    def _learn(self, words: list[str]) -> None:
        found = pa.array(words, pa.large_string())
        plain = pc.match_substring_regex(found, PLAIN)
        odd = found.filter(pc.invert(plain)).to_pylist() + self._learn_plain(found.filter(plain).to_pylist())
        for word, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.known[word] = np.array(e.ids, self.dtype).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Identifiers of distinct words."""
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        parts = {}
        for w in words:
            if w not in known:
                stem = w.rstrip(MARKS)
                parts[w] = stem if stem and stem[-1].lower().isalpha() and "<|" not in w else w
        tails = {w[len(stem):] for w, stem in parts.items() if len(w) > len(stem)}
        self._learn([w for w in {*parts.values(), *tails} if w not in known])
        for w, stem in parts.items():
            if len(w) > len(stem):
                known[w] = known[stem] + known[w[len(stem):]]
        return list(map(known.__getitem__, words))

    def _folded(self, texts: pa.Array) -> pa.Array:
        """Without capitals A-Z, but for texts that may hold special tokens, which are matched with their
        case, or marks that compose with a small letter alone."""
        keep = pc.match_substring(texts, "<|")
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        if ((data & 0xFE) == 0xCC).any():  # first bytes of U+0300 to U+037F
            keep = pc.or_(keep, pc.match_substring_regex(texts, "[\u0300-\u036f]"))
        return pc.if_else(keep, texts, pc.ascii_lower(texts))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        # A copy, as lower-casing misreads arrays that start inside a buffer.
        split = pc.ascii_split_whitespace(self._folded(texts.take(np.arange(len(texts))).cast(pa.large_string())))
        coded = split.flatten().dictionary_encode()
        ids = self._words(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        first = size.cumsum() - size
        ids = np.frombuffer(b"".join(ids), self.dtype)
        at = coded.indices.to_numpy(zero_copy_only=False)
        long = size[at]
        ends = long.cumsum()
        body = ids[np.repeat(first[at] - ends + long, long) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()] * self.dtype.itemsize
        return [body[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """Kept for all tasks of a Python worker."""
    return WordIds(path)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def tokenize(docs: DataFrame, path: str, end_id: int, remembered: int = REMEMBERED) -> DataFrame:
    """``(doc_id, n, sketch, ids, df)``: one row per document, and from each task one row of which
    only ``df`` is set: the number of its documents that hold each identifier."""

    def run(batches):
        words = word_ids(path)
        words.remembered = remembered
        only_memory(words.known)
        end = np.array([end_id], words.dtype).tobytes()
        seen = np.zeros(words.vocabulary, np.int64)
        ranks = [_mix(np.arange(words.vocabulary), s).astype(np.uint32) for s in range(4)]
        for part in by_bytes(batches, 1, TEXT_BYTES):
            rows = []
            for body in words.encode(part.column(1)):
                ids = np.sort(np.frombuffer(body, words.dtype), kind="stable")
                ids = ids[np.concatenate(([True], ids[1:] != ids[:-1]))] if len(ids) else ids
                seen[ids] += 1
                sketch = 0
                for rank in ranks:
                    sketch = sketch << 15 | (int(ids[rank[ids].argmin()]) & 0x7FFF if len(ids) else 0)
                rows.append((len(body) // words.dtype.itemsize + 1, sketch, body + end))
            n, sketch, ids = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(sketch, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(n), pa.binary())],
                names=["doc_id", "n", "sketch", "ids", "df"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.astype("<i8").tobytes()])],
            names=["doc_id", "n", "sketch", "ids", "df"],
        )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, sketch bigint, ids binary, df binary")


def document_frequencies(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Over all documents; at most one row per identifier reaches the driver."""

    def unfold(batches):
        for batch in batches:
            if batch.num_rows:
                total = sum(np.frombuffer(b, "<i8") for b in batch.column(0).to_pylist())
                at = total.nonzero()[0]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "df"])

    counts = tokens.where("df is not null").select("df").mapInArrow(unfold, "id bigint, df bigint").groupBy("id").agg(F.sum("df").alias("df"))
    df = np.zeros(vocabulary)
    for row in counts.toLocalIterator():
        df[row["id"]] = row["df"]
    return df


class Shard:
    """Inverted index of BM25 weights over a bounded number of documents."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.lengths = np.array([len(x) for x in ids], np.int64)
        doc = np.repeat(np.arange(len(ids)), self.lengths)
        key, tf = np.unique(doc * len(idf) + np.concatenate(ids), return_counts=True)
        doc, term = np.divmod(key, len(idf))
        norm = K1 * (1 - B + B * self.lengths / mean_length)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, len(ids))))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the terms of the seed."""
        terms = self.terms[seed]
        low, high = self.first[terms], self.first[terms + 1]
        size = high - low
        at = np.arange(size.sum()) + np.repeat(low - np.concatenate(([0], size.cumsum()[:-1])), size)
        return np.bincount(self.doc[at], self.weight[at], minlength=len(self.lengths))


def fill(shard: Shard, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of a shard."""
    pieces, lengths = [], shard.lengths
    unused = np.ones(len(lengths), bool)
    sequence, offset = 0, 0
    waiting: list[int] = []  # neighbours of the present seed, best last
    following = 0
    while True:
        while waiting and not unused[waiting[-1]]:
            waiting.pop()
        if waiting:
            doc = waiting.pop()
        else:
            while following < len(lengths) and not unused[following]:
                following += 1
            if following == len(lengths):
                break
            doc = following
        seeds = offset == 0
        unused[doc] = False
        start, left = 0, int(lengths[doc])
        while left:
            take = min(left, window - offset)
            pieces.append((doc, start, take, sequence, offset))
            start, left, offset = start + take, left - take, offset + take
            if offset == window:
                sequence, offset, seeds = sequence + 1, 0, True
                waiting = []
        if seeds and offset:
            score = np.where(unused, shard.scores(doc), -1.0)
            waiting = np.argsort(-score, kind="stable")[: int(unused.sum())][::-1].tolist()
    return _cut_tail(pieces, sequence, offset)


def _cut_tail(pieces: list, sequence: int, total: int) -> list:
    """Cut the last, unfilled sequence into sequences whose lengths are powers of two."""
    head = [p for p in pieces if p[3] < sequence]
    tail = [p for p in pieces if p[3] == sequence]
    room = used = 0
    sequence -= 1
    for doc, start, length, _, _ in tail:
        while length:
            if used == room:
                room, used, sequence = 1 << (total.bit_length() - 1), 0, sequence + 1
                total -= room
            take = min(length, room - used)
            head.append((doc, start, take, sequence, used))
            start, length, used = start + take, length - take, used + take
    return head


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all ``docs`` (``doc_id``, non-null ``text``), with their identifiers as little-endian
    32-bit numbers: ``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)``. ``remembered``
    bounds the words that a Python worker remembers; fewer take less memory and more time."""
    words = WordIds(path)
    tokens = stored(tokenize(docs, path, end_id, remembered), "tokens")
    rows = tokens.where("df is null")
    n_docs, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(tokens, words.vocabulary)
    df[end_id] = n_docs
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    dtype, mean_length = words.dtype, total / max(n_docs, 1)

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        held, size = [], 0
        only_memory({})  # no word is looked up any more

        def flush():
            nonlocal base
            ids = [np.frombuffer(b, dtype) for _, b in held]
            pieces = fill(Shard(ids, idf, mean_length), window)
            cols = [[], [], [], [], [], [], []]
            for doc, start, length, sequence, offset in pieces:
                row = (held[doc][0], start, length, len(ids[doc]), base + sequence, offset, ids[doc][start:start + length].astype("<u4").tobytes())
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            base += pieces[-1][3] + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES, strict=True)], schema=PIECES)

        for part in by_rows(batches):
            for doc_id, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held.append((doc_id, body))
                size += len(body) // dtype.itemsize
                if size >= shard_tokens:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    parts = max(1, round(total / (4 * shard_tokens)))
    dealt = rows.select("sketch", "doc_id", "ids").repartitionByRange(parts, "sketch", "doc_id").sortWithinPartitions("sketch", "doc_id", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    )
