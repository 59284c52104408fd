"""Exact top-k by inner product over an inverted index of vector components, by MaxScore.

A term is a dimension; its postings are the vectors whose component there is not zero. For
each query, terms are ordered by the greatest contribution they can make. Those of the
smallest bounds, as long as their sum stays below (a part of) the k-th best score so far,
are non-essential: a vector found in none but them cannot enter. Essential postings are
traversed; what they find is probed for the other terms while it can still compete.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


DENSE = 8
"""A dimension is dense in a block where one vector in so many has a posting of it."""

SLACK = 4
"""What is left out at first can add no more than this part of the threshold. That leaves
out fewer terms than could be, and far fewer vectors to probe for them."""

TOGETHER = 128
"""Queries searched at once."""


class Shard:
    """Postings of one shard of vectors, sorted by id, in blocks, searched for many queries
    at once.

    The postings of a block's dense dimensions, of either sign, are rows of a matrix, so
    that traversing them for all queries is one product; others are lists of vectors. All
    sums are whole numbers, in the shortest type exact for them, beyond 64 bits Python's.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = 4096):
        order = np.argsort(ids, kind="stable")
        self.largest = max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order].T)
        first = min(512, block)  # a small block first, so that the threshold rises early
        self.cuts = [0, *range(first, len(ids), block), len(ids)] if len(ids) > first else [0, len(ids)]
        self.held: dict[type, list] = {}

    def _blocks(self, kind: type) -> list:
        if kind not in self.held:
            self.held[kind] = out = []
            for a, b in zip(self.cuts, self.cuts[1:]):
                part = self.vectors[:, a:b].astype(kind)
                filled = np.count_nonzero(part, axis=1)
                dense = filled * DENSE >= b - a
                lists = [(t, where, part[t, where]) for t in np.flatnonzero(~dense & (filled > 0)).tolist() for where in [np.flatnonzero(part[t])]]
                out.append((self.ids[a:b], part, np.flatnonzero(dense), lists, part.max(1, initial=0), part.min(1, initial=0)))
        return self.held[kind]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, score) of the k best for each row of ``queries``, by
        query, score descending, then id; without the query's ``own`` id. Scores beyond 64
        bits count as the nearest number of 64 bits."""
        most = self.largest * max((sum(map(abs, q)) for q in queries.tolist()), default=0)
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
        found = [(np.zeros(0, np.int64),) * 3]
        for at in range(0, len(queries), TOGETHER):
            row, ids, score = self._search(queries[at : at + TOGETHER].astype(kind), own[at : at + TOGETHER], k, kind)
            found.append((row + at, ids, score))
        return tuple(map(np.concatenate, zip(*found)))

    def _search(self, q: np.ndarray, own: np.ndarray, k: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, wide = q.shape
        row, best_id, best = (np.zeros(0, np.int64),) * 3
        floor, full = np.zeros(n, dtype=kind), np.zeros(n, dtype=bool)  # the k-th best score so far, where there is one
        each = np.arange(n)
        for ids, part, dense, lists, top, low in self._blocks(kind):
            bound = np.maximum(q * top, q * low)
            order = np.argsort(-bound, axis=1, kind="stable")
            rest = np.zeros((n, wide + 1), dtype=kind)  # what terms from here on can add
            rest[:, :wide] = np.cumsum(np.take_along_axis(bound, order, 1)[:, ::-1], axis=1)[:, ::-1]
            # essential: terms until the rest can add but a part of the threshold
            essential = np.where(full & (floor > 0), (rest > (floor // SLACK)[:, None]).sum(1), wide)
            sorted_q = np.zeros((n, wide + 1), dtype=kind)
            sorted_q[:, :wide] = np.take_along_axis(q, order, 1)
            traversed = np.zeros((n, wide), dtype=kind)
            np.put_along_axis(traversed, order, np.where(np.arange(wide) < essential[:, None], sorted_q[:, :wide], 0), 1)
            score = traversed[:, dense] @ part[dense]
            for t, where, impact in lists:
                asks = np.flatnonzero(traversed[:, t])
                score[asks[:, None], where] += traversed[asks, t][:, None] * impact
            at, vector = np.nonzero(~full[:, None] | (score >= (floor - rest[each, essential])[:, None]))
            score = score[at, vector]
            # what can still compete is probed for the others, one after another
            order = np.concatenate([order, np.zeros((n, 1), order.dtype)], 1)
            for j in range(wide - int(essential.min(initial=wide))):
                place = np.minimum(essential[at] + j, wide)
                score = score + sorted_q[at, place] * part[order[at, place], vector]
                alive = np.flatnonzero(~full[at] | (score + rest[at, np.minimum(place + 1, wide)] >= floor[at]))
                at, vector, score = at[alive], vector[alive], score[alive]
            other = ids[vector] != own[at]
            at, vector, score = at[other], vector[other], score[other]
            if kind is object:
                score = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in score], dtype=np.int64)
            row, best_id, best = np.concatenate([row, at]), np.concatenate([best_id, ids[vector]]), np.concatenate([best, score.astype(np.int64)])
            pick = np.lexsort((best_id, ~best, row))  # ~x descends as -x does, and has no overflow
            pick = pick[np.arange(len(pick)) - np.searchsorted(row[pick], row[pick]) < k]
            row, best_id, best = row[pick], best_id[pick], best[pick]
            full = np.bincount(row, minlength=n) >= k
            floor[full] = best[np.searchsorted(row, each[full], "right") - 1]
        return row, best_id, best


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component, as doubles; beyond 64
    bits the nearest number of 64 bits.

    Rows with a null id, a null vector or a null or non-finite component are left out.
    """
    x = F.col("embedding").cast("array<double>")
    most = F.lit((1 << 63) - 1)

    def whole(c):
        y = c * scale
        return F.when(y >= 2.0**63, most).when(y < -(2.0**63), -most - 1).otherwise(F.floor(y))

    good = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(good).select(F.col("vec_id").cast("long"), F.transform(x, whole).alias("v"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = 16384, query_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all candidates (vec_id, v) for each
    query (vec_id, v), without the query's own id; ties to the smaller id.

    Queries are packed into blocks, each block is sent to every shard of candidates, and
    the k best of each shard are merged. Vectors of different lengths count as padded
    with zeros. Rows repeating an id and vector are candidates as often as they come;
    an empty side gives no rows.
    """
    spark = candidates.sparkSession
    n = candidates.count()
    shards = max(1, -(-n // shard_rows))

    def packed(df, rows, number, name):
        """Blocks of vectors, as one row each: ids and components as bytes."""

        def run(key, g):
            vs = g.column("v").to_pylist()
            wide = max(map(len, vs), default=0)
            m = np.zeros((len(vs), wide), dtype="<i8")
            for i, v in enumerate(vs):
                m[i, : len(v)] = v
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([g.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], [name, "ids", "m"])

        part = F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(number)).cast("int")
        return df.select("vec_id", "v", part.alias(name)).groupBy(name).applyInArrow(run, f"{name} int, ids binary, m binary")

    n_queries = queries.count()
    blocks = packed(queries, query_rows, max(1, -(-n_queries // query_rows)), "block")
    sent = blocks.select("block", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = packed(candidates, shard_rows, shards, "shard")
    met = held.join(sent, "shard").repartition(max(1, min(shards * max(1, -(-n_queries // query_rows)), 4 * common.parts_for(spark))), "shard", "block")

    def search(batches):
        last = (None, None)
        for b in batches:
            for key, ids, m, q_ids, q_m in zip(*(b.column(c).to_pylist() for c in ("shard", "ids", "m", "q_ids", "q_m"))):
                if last[0] != key:
                    a = np.frombuffer(ids, "<i8")
                    last = (key, Shard(a, np.frombuffer(m, "<i8").reshape(len(a), -1)))
                shard = last[1]
                a = np.frombuffer(q_ids, "<i8")
                q = np.frombuffer(q_m, "<i8").reshape(len(a), -1)
                wide = shard.vectors.shape[0]
                q = q[:, :wide] if q.shape[1] >= wide else np.pad(q, ((0, 0), (0, wide - q.shape[1])))
                row, found, score = shard.search(q, a, k)
                yield pa.record_batch([pa.array(a[row]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    found = met.sortWithinPartitions("shard").mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
