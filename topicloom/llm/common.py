"""Shared parts of the training-data operators: words, stored intermediates, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path

SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ROWS = 256


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once below the shared checkpoint folder and read back, so that later jobs restart from files."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``(doc_id, text)`` and the columns to keep, a null text as an empty one; others cannot clash.

    An id that is right already is taken as it is: an alias of it would tell two equal reads of the
    same documents apart, and their shuffle could not be shared.
    """
    ident = F.col(f"`{id_col}`")
    if id_col != "doc_id" or dict(docs.dtypes)[id_col] != "bigint":
        ident = ident.cast("bigint").alias("doc_id")
    return docs.select(ident, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *keep)


def small(table: DataFrame, rows: int = 300_000) -> DataFrame:
    """A stored table of narrow rows, with a broadcast asked for if it has at most ``rows`` rows.

    Beyond that it takes part in an ordinary join, whose skewed partitions the engine splits.
    """
    return F.broadcast(table) if table.count() <= rows else table


def words(text: Column) -> Column:
    """Array of the words of a non-null text."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def fold(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_bytes(text: str, lower: bool = False) -> list[bytes]:
    """Words as UTF-8 bytes; ``bytes.split`` and ``bytes.lower`` know ASCII only."""
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


class WordHash(dict):
    """64-bit hashes of words, remembered up to a number of entries."""

    def __init__(self, limit: int = 400_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value


_holder: dict = {}


def only_memory(remembered: dict) -> None:
    """Clear what an operator remembered in this Python worker when another one begins to remember.

    A worker lives through the tasks of many stages; together their memories would outgrow it.
    """
    if _holder.get("of") is not remembered:
        _holder.get("of", {}).clear()
        _holder["of"] = remembered
        pa.default_memory_pool().release_unused()


def by_rows(batches: Iterable[pa.RecordBatch], step: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut to a few rows, so that Python holds few texts as objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def by_bytes(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where the text of a column reaches a number of bytes; a longer text is a batch by itself."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def per_document(docs: DataFrame, make: Callable[[], Callable[[list, list], list]], schema: str) -> DataFrame:
    """Map ``(doc_id, text)`` rows: ``make()`` runs once per task and gives a function from the ids
    and texts of a few rows to the columns of ``schema``, in order."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = docs.sparkSession.createDataFrame([], schema).schema
    assert isinstance(shape, StructType)
    arrow = to_arrow_schema(shape)

    def run(batches):
        work = make()
        for part in by_rows(batches):
            columns = work(part.column(0).to_pylist(), part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, shape)
