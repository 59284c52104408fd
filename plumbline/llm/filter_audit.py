"""How filters of a corpus interact: what each removes, in every order of applying them.

A document is a mask of the filters it fails. For each part of the corpus the masks are
counted, with weights; what follows needs these counts only. The step at which an order
removes a mask is a min-plus product: the least, over the filters, of the mask matrix
(0 where it fails, infinite where it passes) plus the order's position matrix (the inverse
of the permutation). Counts are scattered by that step.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: str = "text") -> dict[str, Column]:
    """Failure conditions on a text column (null: empty): A under 100 words, B distinct words
    below 80 in 100, C capitals above 10 in 100 code points, D one of ``#$%&*|``."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * capitals.cast("long") > 10 * F.length(t).cast("long"),
        "D": t.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, failures: dict[str, Column], repeated: str | None = None, part: str = "lang", flags: DataFrame | None = None) -> DataFrame:
    """(part, mask, n, a sum of each flag): counts of documents by the filters they fail, bit
    k of the mask for the k-th of ``failures``, then one for ``repeated``, the filter that
    fails a text identical to that of any smaller doc_id.

    ``flags`` has doc_id and columns of 0 or 1; several rows of a doc_id count as one that
    has a flag if any has, and documents without a row have none. A null part counts as
    the empty string. A null doc_id is not smaller or larger than any: such rows never
    fail ``repeated``, and have no flags. Rows that repeat a doc_id count each.
    """
    names = [c for c in flags.columns if c != "doc_id"] if flags is not None else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(failures.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    none = [F.lit(0).alias(c) for c in names]
    if flags is None:
        marked = rows
    else:
        known = flags.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c) for c in names])
        met = rows.filter("doc_id is not null").join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id")
        marked = met.withColumns({c: F.coalesce(c, F.lit(0)) for c in names}).unionByName(rows.filter("doc_id is null").select("*", *none))
    sums = [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in names]]
    if repeated is None:
        return marked.groupBy("part", "mask", *names).agg(F.count("*").alias("n")).groupBy("part", "mask").agg(*sums)
    # rows of a text are counted by what they share before its smallest doc_id is sought
    each = marked.groupBy("digest", "part", "mask", *names, "doc_id").agg(F.count("*").alias("n"))
    few = each.groupBy("digest", "part", "mask", *names).agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    lowest = few.groupBy(F.col("digest").alias("_digest")).agg(F.min("low").alias("lowest"))
    met = few.join(lowest, F.col("digest") == F.col("_digest"))
    first = F.col("n_null") + F.when(F.col("low") == F.col("lowest"), F.col("n_low")).otherwise(0)
    split = F.array(F.struct(F.col("mask"), first.alias("n")), F.struct((F.col("mask") + (1 << len(failures))).alias("mask"), (F.col("n") - first).alias("n")))
    dealt = met.select("part", *names, F.explode(split).alias("s")).select("part", *names, "s.mask", "s.n").filter("n > 0")
    return dealt.groupBy("part", "mask").agg(*sums)


def removal_steps(filters: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders, steps): all orders of the filters, and for each mask (row) and order
    (column) the step, from 0, that removes it; ``filters`` if none does."""
    orders = np.array(list(itertools.permutations(range(filters))))
    position = np.argsort(orders, axis=1)
    fails = np.arange(1 << filters)[:, None] >> np.arange(filters) & 1
    cost = np.where(fails == 1, 0, filters)
    return orders, np.minimum((cost[:, None, :] + position[None, :, :]).min(2), filters)


def interactions(weights: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Counts of each order and step, from the weights (masks x kinds, the first of them
    the documents themselves): kept, removed (orders x steps x kinds), redundant,
    unique_fails and shapley."""
    orders, steps = removal_steps(filters)
    at = np.arange(len(orders))
    removed = np.zeros((len(orders), filters + 1, weights.shape[1]), dtype=np.int64)
    np.add.at(removed, (at[None, :], steps), weights[:, None, :])
    removed = removed[:, :filters]
    n = weights[:, 0]
    fails = (np.arange(1 << filters)[:, None] >> np.arange(filters) & 1).astype(bool)
    failing = (n[:, None] * fails).sum(0)[orders]
    only = n[1 << np.arange(filters)][orders]
    total = np.zeros(filters, dtype=np.int64)
    np.add.at(total, orders, removed[:, :, 0])
    return {"kept": n.sum() - removed[:, :, 0].cumsum(1), "removed": removed, "redundant": failing - removed[:, :, 0], "unique_fails": only, "shapley": total[orders], "orders": orders}


def audit(counted: DataFrame, filters: list[str]) -> DataFrame:
    """One row per part, order of the ``filters`` (their names joined) and step (from 1):
    kept (after the step), removed (at it), redundant (failing its filter, removed
    before), unique_fails (failing its filter only), <flag>_lost (removed at it, with the
    flag) and shapley (what its filter removes, summed over all orders).

    ``counted`` is what ``masks`` returns; a part's rows are at most one per mask. Up to
    eight filters (40,320 orders). No documents give no rows.
    """
    if not 1 <= len(filters) <= 8:
        raise ValueError("from one to eight filters")
    names = [c for c in counted.columns if c not in ("part", "mask", "n")]
    gathered = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", *names)).alias("masks"))
    k = len(filters)

    def run(batches):
        for b in batches:
            for part, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                weights = np.zeros((1 << k, 1 + len(names)), dtype=np.int64)
                for m in found:
                    weights[m["mask"]] = [m["n"], *(m[c] for c in names)]
                got = interactions(weights, k)
                orders = got["orders"]
                rows = orders.size
                text = np.repeat(["".join(filters[f] for f in o) for o in orders], k)
                columns = [pa.array([part] * rows, pa.string()), pa.array(text.tolist(), pa.string()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))]
                columns += [pa.array(np.ascontiguousarray(x).reshape(-1)) for x in (got["kept"], got["removed"][:, :, 0], got["redundant"], got["unique_fails"], *(got["removed"][:, :, 1 + i] for i in range(len(names))), got["shapley"])]
                yield pa.RecordBatch.from_arrays(columns, schema_names)

    schema_names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{c}_lost" for c in names), "shapley"]
    types = ["string", "string", "int", *["long"] * (len(schema_names) - 3)]
    return common.checkpoint(gathered).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(schema_names, types)))
