"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes.

File format, little-endian: blocks, one after another, each

    magic ``TKB1``; n_docs, n_ids, n_data as uint32
    n_docs document ids (int64), n_docs null flags (uint8), n_docs lengths (uint32)
    control bytes, one for four ids: two bits each, bytes of the id's rank less one
    data bytes: ranks, low byte first, in 1 to 4 bytes each

Ids are replaced by their frequency rank over the whole corpus, so that the most frequent
256 take one byte. ``ranks.npy`` beside the files maps ranks to ids. A file holds one
range of document ids in ascending order, and files are numbered in that order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

MAGIC = b"TKB1"
_WIDTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
"""For each control byte, the widths of its four ranks."""


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of an array of ranks below 2**32."""
    n = len(ranks)
    if not n:
        return b"", b""
    ranks = ranks.astype("<u4")
    width = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, dtype=np.uint8)
    codes[:n] = width - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(1, dtype=np.uint8)
    keep = np.arange(4, dtype=np.uint8)[None, :] < width[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The inverse: widths by table lookup, then one gather for each byte place."""
    width = _WIDTHS[control].reshape(-1)[:n]
    start = np.cumsum(width, dtype=np.int64) - width
    out = np.zeros(n, dtype=np.uint32)
    for k in range(int(width.max(initial=0))):
        has = np.flatnonzero(width > k)
        out[has] |= data[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(out, doc_ids: list, ids: list[np.ndarray], rank_of: np.ndarray) -> None:
    lengths = np.array([len(x) for x in ids], dtype="<u4")
    ranks = rank_of[np.concatenate(ids)] if ids else np.zeros(0, np.uint32)
    control, data = encode_ranks(ranks)
    out.write(MAGIC + struct.pack("<III", len(doc_ids), len(ranks), len(data)))
    out.write(np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes())
    out.write(np.array([d is None for d in doc_ids], dtype="u1").tobytes() + lengths.tobytes() + control + data)


def read_blocks(stream, id_of: np.ndarray) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(document ids, ids of each document), a block at a time."""
    while head := stream.read(16):
        if head[:4] != MAGIC or len(head) < 16:
            raise ValueError("not a token block")
        n_docs, n, n_data = struct.unpack("<III", head[4:])
        doc_ids = np.frombuffer(stream.read(8 * n_docs), "<i8").tolist()
        null = np.frombuffer(stream.read(n_docs), "u1")
        lengths = np.frombuffer(stream.read(4 * n_docs), "<u4")
        control = np.frombuffer(stream.read(-(-n // 4)), "u1")
        data = np.frombuffer(stream.read(n_data), "u1")
        ids = id_of[decode_ranks(control, data, n)]
        yield [None if z else d for d, z in zip(doc_ids, null)], np.split(ids, np.cumsum(lengths)[:-1]) if n_docs else []


def encoded(docs: DataFrame, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """(doc_id, ids binary): ids of each whole text and ``end_id``, zstd-compressed."""
    common.small_batches(docs.sparkSession, 2500)

    def encode(batches):
        import zstandard

        enc, end, pack = encoder(tokenizer, kind), struct.pack("<I", end_id), zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([pack(x + end) for x in enc.encode(b.column(1))], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, kind: str = "word", end_id: int = 2, block_ids: int = 1 << 18) -> DataFrame:
    """Write the ids of all ``docs`` (doc_id, text; other columns are ignored) below
    ``path``; returns the manifest (shard int, file string, docs long, n_tokens long).

    A null text counts as empty: its ids are just the end id. A null doc_id comes first.
    Rows that repeat a doc_id are all written, in the order of their ids. An empty table
    gives an empty manifest. Counts and the rank table are bounded by the vocabulary, so
    the driver may hold them; nothing else leaves the executors.
    """
    spark = docs.sparkSession
    table = common.stored(encoded(docs, tokenizer, kind, end_id), "ids")

    def count(batches):
        import zstandard

        total, unpack = np.zeros(0, np.int64), zstandard.ZstdDecompressor().decompress
        held: list[bytes] = []
        size = 0

        def add():
            found = np.bincount(np.frombuffer(b"".join(held), "<u4"), minlength=len(total))
            found[: len(total)] += total
            held.clear()
            return found

        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(unpack(x))
                size += len(held[-1])
                if size >= 4 * block_ids:
                    total, size = add(), 0
        total = add()
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = table.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values(["n", "id"], ascending=[False, True])
    id_of = counts["id"].to_numpy(np.uint32)
    fs, base = common.filesystem(path)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/ranks.npy") as out:
        out.write(id_of.astype("<u4").tobytes())
    rank_of = np.zeros(int(id_of.max(initial=0)) + 1, dtype=np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def write(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        fs, base = common.filesystem(path)
        state = {"shard": None}

        def flush():
            if state["ids"]:
                write_block(state["out"], state["doc_ids"], state["ids"], shared.value)
                state["docs"] += len(state["ids"])
            state.update(doc_ids=[], ids=[], size=0)

        def close():
            flush()
            state["out"].close()
            return pa.record_batch([[state["shard"]], [state["file"]], [state["docs"]], [state["n"]]], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("n_tokens", pa.int64())]))

        for b in batches:
            for shard, doc_id, x in zip(*(b.column(k).to_pylist() for k in range(3))):
                if shard != state["shard"]:
                    if state["shard"] is not None:
                        yield close()
                    name = f"{base}/part-{shard:06d}-{uuid.uuid4().hex[:8]}.tkb"
                    state = {"shard": shard, "file": name, "out": fs.open_output_stream(name), "docs": 0, "n": 0, "doc_ids": [], "ids": [], "size": 0}
                ids = np.frombuffer(unpack(x), "<u4")
                state["doc_ids"].append(doc_id)
                state["ids"].append(ids)
                state["n"] += len(ids)
                state["size"] += len(ids)
                if state["size"] >= block_ids:
                    flush()
        if state["shard"] is not None:
            yield close()

    parts = common.parts_for(spark)
    bounds = common.range_bounds(table, "doc_id", 2 * parts)
    shards = table.select(common.range_bucket("doc_id", bounds).alias("shard"), "doc_id", "ids")
    manifest = shards.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(write, "shard int, file string, docs long, n_tokens long")
    return common.stored(manifest, "manifest")


def read_token_files(spark, path: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as little-endian uint32), and ids if asked for."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("shard", "file", F.coalesce(before, F.lit(0)).alias("start"))

    def read(batches):
        fs, base = common.filesystem(path)
        with fs.open_input_stream(f"{base}/ranks.npy") as f:
            id_of = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_stream(file) as stream:
                    for doc_ids, ids in read_blocks(stream, id_of):
                        n = np.array([len(x) for x in ids], dtype=np.int64)
                        starts = start + np.cumsum(n) - n
                        start += int(n.sum())
                        columns = [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                        if with_ids:
                            columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    # one file may take a task of its own: there are as many files as twice the partitions
    spread = files.repartition(common.parts_for(spark) * 2, "file").select("file", "start")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
