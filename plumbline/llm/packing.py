"""Best-fit packing of token pieces into sequences under several capacities.

A sequence has three capacities: tokens, documents and attention cost (the sum of the
squared lengths of its pieces). Pieces come in descending length; a piece goes to the open
sequence with the best score among those that can take it under every constraint. Scores
are vector best-fit ones: the weighted dot product of the piece and the residual
capacities, or the weighted norm of what would remain.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder


WEIGHTS = (1.0, 1.0, 1.0)
"""Of tokens, documents and attention cost in the score."""


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole if it fits, else full pieces behind a first
    one that takes what is left over."""
    full, first = divmod(n, capacity)
    return [first] * bool(first) + [capacity] * full


def pieces(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document of ``docs``.

    A null text counts as empty and gives one piece with the end id. Rows that repeat a
    doc_id each give their pieces. An empty table gives none.
    """
    common.small_batches(docs.sparkSession, 2500)

    def cut(batches):
        enc, end = encoder(tokenizer, kind), struct.pack("<I", end_id)
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                ids += end
                at = 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + n)]
                    rows.append((doc_id, k, at, n, zlib.crc32(part), np.frombuffer(part, "<u4").tolist() if with_ids else None))
                    at += n
            kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def best_fit(lengths: np.ndarray, tokens: int, documents: int, cost: int, weights=WEIGHTS, rule: str = "norm") -> np.ndarray:
    """Bin of each piece, in the order given (longest first packs best).

    Capacities are scaled to 1. ``rule`` "norm" takes the bin whose weighted residual
    after the piece is least; "dot" the one with the greatest weighted dot product of
    demand and residual. Ties go to the oldest bin.
    """
    out = np.empty(len(lengths), dtype=np.int64)
    room = np.zeros((3, 64))  # residual capacities of open bins: whole numbers far below 2**53
    label = np.zeros(64, dtype=np.int64)
    used = bins = 0
    a, b, c = (w / s**2 for w, s in zip(weights, (tokens, max(documents, 1), max(cost, 1))))
    least = int(lengths.min(initial=0))
    for i, n in enumerate(lengths.tolist()):
        x, y, z = room[:, :used]
        if rule == "norm":
            score = a * np.square(x - n) + b * np.square(y - 1) + c * np.square(z - n * n)
        else:
            score = -(a * n * x + b * y + c * n * n * z)
        score[(x < n) | (y < 1) | (z < n * n)] = np.inf
        best = int(score.argmin()) if used else -1
        if best < 0 or score[best] == np.inf:
            if used == room.shape[1]:
                room, label = np.concatenate([room, np.zeros_like(room)], 1), np.concatenate([label, np.zeros_like(label)])
            best, used = used, used + 1
            room[:, best] = (tokens, documents, cost)
            label[best] = bins
            bins += 1
        room[:, best] -= (n, 1, n * n)
        out[i] = label[best]
        if room[0, best] < least or room[1, best] < 1 or room[2, best] < least * least:  # closed: keep the order of the others
            room[:, best : used - 1] = room[:, best + 1 : used].copy()
            label[best : used - 1] = label[best + 1 : used].copy()
            used -= 1
    return out


def pack(items: DataFrame, tokens: int = 1024, documents: int | None = None, cost: int | None = None, weights=WEIGHTS, rule: str = "norm", group_rows: int = 20_000, waste: float = 1 / 64) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...). A sequence holds at
    most ``tokens``, ``documents`` pieces (default: as many as tokens) and a ``cost`` (default:
    that of one full piece, so that every piece fits somewhere). No set of pieces that fits
    by tokens exceeds these defaults: they take part in the score and cost no sequence.

    Pieces are dealt at random into groups of about ``group_rows``, each packed in one
    task, longest first. The sequences of the first round that stay emptier than
    ``waste`` are opened again, and their pieces are packed in fewer groups. Full pieces
    take a sequence of their own. Rows with a null length or one over ``tokens`` are an
    error of the caller's and raise; repeated rows are packed as often as they come.
    """
    documents = tokens if documents is None else documents
    cost = tokens * tokens if cost is None else cost
    columns = [c for c in items.columns if c not in ("sequence_id", "offset")]
    items = common.checkpoint(items.select(*columns, F.monotonically_increasing_id().alias("_row")))
    schema = "_row long, length long, _group long, _bin long, offset long, _left long"

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["length", "_row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        n = pdf["length"].to_numpy(np.int64)
        if len(n) and (n.max() > tokens or n.min() < 1):
            raise ValueError("a piece does not fit any sequence")
        bins = best_fit(n, tokens, documents, cost, weights, rule)
        pdf["_bin"] = bins
        pdf["offset"] = pdf.groupby("_bin")["length"].cumsum() - pdf["length"]
        pdf["_left"] = tokens - pd.Series(n).groupby(bins).transform("sum")
        return pdf[["_row", "length", "_group", "_bin", "offset", "_left"]].astype("int64")

    def one_round(df, rows, label):
        groups = max(1, -(-rows // group_rows))
        dealt = df.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(label)), F.lit(groups)))
        return common.checkpoint(dealt.groupBy("_group").applyInPandas(run, schema))

    short = items.filter((F.col("length") < tokens) | F.col("length").isNull() | (F.col("length") > tokens)).select("_row", "length")
    first = one_round(short, short.count(), 1)
    done = first.filter(F.col("_left") <= waste * tokens).withColumn("_round", F.lit(1))
    again = first.filter(F.col("_left") > waste * tokens).select("_row", "length")
    second = one_round(again, again.count(), 2).withColumn("_round", F.lit(2))
    placed = done.unionByName(second)
    # round, group and bin number a sequence; full pieces are numbered by their row
    number = F.col("_group") * F.lit(2 * group_rows * 8) + F.col("_bin")
    found = placed.select("_row", (number * 3 + F.col("_round")).alias("sequence_id"), "offset")
    full = items.filter(F.col("length") == tokens).select("_row", (F.col("_row") * 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return items.join(found.unionByName(full), "_row").drop("_row")
