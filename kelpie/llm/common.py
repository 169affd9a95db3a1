"""Helpers shared by the operators: stored tables, column names, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch are read by column name; these are the input's columns inside the operators.
ID, TEXT = "doc_id", "text"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder and a cluster its warehouse.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        local = context.master.startswith("local[") or context.master == "local"
        context.setCheckpointDir(
            tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        )
    return context.getCheckpointDir().rstrip("/")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: it is computed once and its lineage ends here."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def apart(rows: DataFrame, **named: Column) -> DataFrame:
    """The named columns, and `row`: all columns of the rows in one, so that none of their names meets one of an operator's own."""
    whole = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in rows.columns)).alias("row")
    return rows.select(*(c.alias(name) for name, c in named.items()), whole)


def together(frame: DataFrame, columns: list[str], *added: str) -> DataFrame:
    """The columns of the rows that `apart` took together, but those that are added."""
    new = {c.lower() for c in added}
    return frame.select(*(F.col("row").getField(c).alias(c) for c in columns if c.lower() not in new), *added)


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    """The named columns row by row: one row's values are Python objects at a time."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in columns)


def chunked(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Lists of at most so many rows."""
    while some := list(islice(rows, size)):
        yield some


def columns_of(batches: Iterator, *names: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each Arrow batch as Python lists."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


# --- words ------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


_AT_ONCE = 1 << 20  # symbols that are hashed at a time, but for a longer range


def placed(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the mixed symbols of the ranges, which don't overlap, and where each range begins in them. A symbol is mixed
    with its place in its range, so that no power or other linear rule ties one symbol's part to another's."""
    size = ends - starts
    stop = np.cumsum(size)
    first = stop - size
    total = int(stop[-1]) if len(stop) else 0
    order = np.arange(total)
    place = order - np.repeat(first, size)
    inside = symbols[order + np.repeat(starts - first, size)].astype(np.uint64)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(mixed((inside + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + mixed(place.astype(np.uint64) + np.uint64(1))), out=sums[1:])
    return sums, first


def range_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, beginnings: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each range of symbols, independent of where it lies; the ranges don't overlap and come in order. With
    beginnings, a row for each: the whole range, and its first so many symbols."""
    out, low = [np.zeros((1 + len(beginnings), 0), np.uint64)], 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _AT_ONCE, "right")))
        sums, first = placed(symbols, starts[low:high], ends[low:high])
        size = ends[low:high] - starts[low:high]
        lengths = [size, *(np.minimum(size, n) for n in beginnings)]
        out.append(np.stack([mixed(sums[first + n] - sums[first] + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) for n in lengths]))
        low = high
    found = np.concatenate(out, 1)
    return found if beginnings else found[0]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, and starts and ends of the words: runs of bytes other than ASCII white space."""
    values = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(values) + 2, np.int8)
    inside[1:-1] = ~_SPACE[values]
    steps = np.diff(inside)
    return values, np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_hashes(data: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, A-Z lower-cased."""
    if not data:
        return np.zeros(0, np.uint64)
    values, starts, ends = word_spans(data.lower())
    return range_hashes(values, starts, ends)
