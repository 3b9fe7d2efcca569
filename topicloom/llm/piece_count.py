"""Token counts by byte-pair merging with a heap over a linked list; no identifiers are made.

The symbols of a segment form a doubly linked list; every adjacent pair that is a piece of the
vocabulary waits in a heap by rank, then position. The best pair is merged until none is left, so the
count is the number of first symbols less the merges; a symbol outside the vocabulary counts one
token for each of its bytes. Cost is ``n log n`` in the length of a segment.

A text is first cut where no piece of the vocabulary can span the cut (checked against every piece
when the vocabulary is loaded; if a piece does span it, texts are not cut there), and counts of
segments are remembered up to a bound.

A null text is empty and has no tokens. Rows are counted one by one: repeated rows repeat, an empty
table stays empty, further columns are not read.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_document

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in the model format
LETTER = r"[^\W\d_²]"
CUTS = (
    re.compile(f"{SPACE}*(?:{LETTER}+|(?:(?!{LETTER}|{SPACE}).)+)|{SPACE}+", re.S),
    re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S),
    re.compile(".+", re.S),
)
REMEMBERED = 1_500_000


def load_ranks(path: str) -> dict[str, int]:
    """Rank of every mergeable piece: the higher its score, the earlier."""
    import sentencepiece as sp

    model = sp.SentencePieceProcessor(model_file=path)
    pieces = [
        (-model.GetScore(i), i, model.IdToPiece(i))
        for i in range(model.GetPieceSize())
        if not (model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i) or model.IsUnused(i))
    ]
    return {piece: rank for rank, (_, _, piece) in enumerate(sorted(pieces))}


def merge_count(segment: str, ranks: dict[str, int], pieces: list[str]) -> int:
    """Tokens of one segment; ``pieces`` lists the pieces by rank.

    A heap entry is one number, the rank above the position of the pair's left symbol. It is stale
    when the symbols now at that place no longer make the piece of that rank.
    """
    n = len(segment)
    symbols: list[str] = [*segment, ""]
    heap = []
    for i in range(n - 1):
        rank = ranks.get(segment[i:i + 2])
        if rank is not None:
            heap.append(rank << 32 | i)
    tokens = n
    if heap:
        heapq.heapify(heap)
        pop, push, rank_of = heapq.heappop, heapq.heappush, ranks.get
        before, after = list(range(-1, n)), list(range(1, n + 2))
        while heap:
            entry = pop(heap)
            left = entry & 0xFFFFFFFF
            right = after[left]
            piece = pieces[entry >> 32]
            if right >= n or not symbols[left] or symbols[left] + symbols[right] != piece:
                continue
            symbols[left], symbols[right] = piece, ""
            tokens -= 1
            following = after[left] = after[right]
            if following < n:
                before[following] = left
                rank = rank_of(piece + symbols[following])
                if rank is not None:
                    push(heap, rank << 32 | left)
            previous = before[left]
            if previous >= 0:
                rank = rank_of(symbols[previous] + piece)
                if rank is not None:
                    push(heap, rank << 32 | previous)
    for symbol in symbols:
        if symbol and symbol not in ranks:
            tokens += len(symbol.encode("utf-8", "surrogatepass")) - 1
    return tokens


class Counts(dict):
    """Remembered counts of segments."""

    def __init__(self, ranks: dict[str, int], limit: int = REMEMBERED):
        super().__init__()
        self.ranks, self.limit = ranks, limit
        self.pieces = sorted(ranks, key=ranks.get)

    def __missing__(self, segment: str) -> int:
        value = merge_count(segment, self.ranks, self.pieces)
        if len(segment) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[segment] = value
        return value


@lru_cache(maxsize=2)
def make_counter(path: str):
    """Function from a text to its number of tokens; kept for all tasks of a Python worker."""
    ranks = load_ranks(path)
    cut = next(c for c in CUTS if all(c.findall(p) == [p] for p in ranks))
    counts, segments = Counts(ranks), cut.findall

    def count(text: str) -> int:
        return sum(map(counts.__getitem__, segments(SPACE + text.replace(" ", SPACE)))) if text else 0

    return count


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for rows of ``(doc_id, text)`` with a non-null text."""

    def make():
        count = make_counter(model_path)

        def work(ids, texts):
            n = [count(t) for t in texts]
            return ids, [len(t.encode("utf-8", "surrogatepass")) for t in texts], n

        return work

    counted = per_document(docs, make, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
