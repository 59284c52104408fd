"""Shared helpers: the cluster's shared folder, ordered buckets and vectorised word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import new_path, stored  # noqa: F401  (new_path: for the modules beside)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage, as a table in the shared folder: computed once, and without what a
    checkpointed plan keeps of its origin (in loops that grows from round to round)."""
    return stored(df, "cut")


def merged(df: DataFrame) -> DataFrame:
    """``df``, for joins by sort and merge only: for tables that grow with the input. Spark
    guesses their size from compressed files, and an exploded row counts as one, so it would
    broadcast some that fill the driver."""
    return df.hint("merge")


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI such as file:///x or hdfs://host/x."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def range_bounds(df: DataFrame, column: str, parts: int) -> list:
    """At most ``parts - 1`` ascending cut values of a column, from an approximate
    quantile summary (bounded in size, whatever the input)."""
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10 * parts).alias("b")).first()["b"]
    return sorted(set(found or []))


def range_bucket(column: Column | str, bounds: list) -> Column:
    """Index of the range that a value falls in (null: 0): values up to and including
    the first bound get 0. ``bounds`` holds one value per bucket only."""
    c = F.col(column) if isinstance(column, str) else column
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(int(b)) for b in bounds])
    return F.coalesce(F.aggregate(cuts, F.lit(0), lambda n, b: n + (c > b).cast("int")), F.lit(0))


def parts_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---- words and hashes, by numpy over the bytes of one text ----

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_powers = {"r": np.ones(1, dtype=np.uint64), "i": np.ones(1, dtype=np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base or its inverse, modulo 2**64; grown by doubling."""
    have = _powers[kind]
    if len(have) < n:
        base = _R if kind == "r" else _RINV
        size = max(1 << 16, 1 << (n - 1).bit_length())
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = _powers[kind] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[np.frombuffer(data, dtype=np.uint8)]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal words wherever they stand.

    Blocks of eight bytes are mixed in one after the other, for all words at once, so that
    no sums of letters cancel; words of more than 64 bytes are hashed by XXH3.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * _R)
    block = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    at = np.flatnonzero(size <= 64)
    for k in range(0, 64, 8):
        at = at[size[at] > k] if k else at
        if not len(at):
            break
        out[at] = mix((out[at] ^ block[starts[at] + k] & _LOW[np.minimum(size[at] - k, 8)]) * _R)
    for at in np.flatnonzero(size > 64).tolist():
        out[at] = xxhash.xxh3_64_intdigest(data[starts[at] : ends[at]], 42)
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes (fewer words: of the whole sequence). What came
    before is mixed ahead of each further word, so that no sums of words cancel."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    out = words[: len(words) - k + 1] + np.uint64(k)
    for j in range(1, k):
        out = mix(out) * _R + words[j : len(words) - k + 1 + j]
    return mix(out)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column (null: empty)."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of texts small, for bounded memory in Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
