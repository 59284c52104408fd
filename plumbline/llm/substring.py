"""Repeated passages by seed and extend.

Seeds: of the word runs of length ``window - spread + 1`` in each window, the one of the
least hash is its anchor (winnowing), so equal windows share an anchor at the same place.
Anchors are joined over all documents. Extension: around a shared anchor, the stretch of
all windows that chose it is compared both ways; where the stretches of a seed differ, the
windows in them are compared one by one. Repeated windows are merged into maximal repeats.
Word sequences count as equal where two 64-bit hashes agree: that of the anchor in them
and that of the whole.

Texts stay out of these joins: rows carry hashes and places, and stretches that are alike
are compared once, whatever number of documents holds them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


def _prefix(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * common._power("r", len(words)), out=out[1:])
    return out


def _stretch(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the word runs [a, b), equal for equal runs."""
    return common.mix((prefix[b] - prefix[a]) * common._power("i", len(prefix))[a] + (b - a).astype(np.uint64))


def anchors(words: np.ndarray, window: int, spread: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, stretch hash, first window, last window) of each run of windows that
    chose the same anchor. A tie goes to the rightmost place."""
    n = len(words) - window + 1
    if n < 1:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    prefix = _prefix(words)
    k = window - spread + 1
    at = np.arange(len(words) - k + 1)
    seeds = _stretch(prefix, at, at + k)
    back = np.lib.stride_tricks.sliding_window_view(seeds[::-1], spread).argmin(1)[::-1]
    chosen = np.arange(n) + spread - 1 - back
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    place = (chosen[first] - first).astype(np.uint64)
    return seeds[chosen[first]], common.mix(_stretch(prefix, first, last + window) + place), first, last


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _d and _t: 88 bits of two hashes of the row's doc_id and text, so that
    only rows which repeat each other, and so share all places, have the same."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [F.col("doc_id").cast("long"), F.col("doc_id").isNull(), text]
    return docs.select("*", F.xxhash64(*row).alias("_d"), F.pmod(F.xxhash64(F.lit(1), *row), F.lit(1 << 24)).alias("_t"))


def repeats(docs: DataFrame, window: int = 35, spread: int = 20) -> DataFrame:
    """(_d, _t, marks): for each distinct row of ``docs`` with repeated windows, structs of
    the first window of a run and a mask of its windows (bit i: window first + i) whose
    word sequence also starts anywhere else.

    A place is one number: _t, then the first window, then how many follow.
    """
    if not 2 <= spread <= min(window, 62):
        raise ValueError("spread: 2 to 62, and at most the window")
    rows = _keyed(docs).select("_d", "_t", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def hashed(text: bytes) -> np.ndarray:
        return common.word_hashes(text, *common.word_spans(text))

    def seed(batches):
        for b in batches:
            found = [anchors(hashed(t), window, spread) for t in common.texts_of(b.column(2))]
            n = [len(f[0]) for f in found]
            h, s, first, last = (np.concatenate([f[k] for f in found]) for k in range(4))
            tag = np.repeat(b.column(1).to_numpy(), n) << 38
            yield pa.record_batch([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(tag + first * 64 + (last - first))], ["_d", "seed", "stretch", "at"])

    # both uses compute the seeds anew: cheaper than to keep a row for every tenth word
    seeds = rows.mapInArrow(seed, "_d long, seed long, stretch long, at long")
    # small results are checkpointed before they are joined: Spark can then split hot keys
    busy = common.checkpoint(seeds.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"))
    shared = common.checkpoint(seeds.join(busy, "seed"))
    alike = common.checkpoint(shared.groupBy("seed").agg((F.min("stretch") == F.max("stretch")).alias("alike")))
    shared = common.checkpoint(shared.join(alike, "seed").select("_d", "seed", "stretch", "at", "alike"))
    full = F.expr("shiftleft(1L, cast(at % 64 as int) + 1) - 1")
    whole = shared.filter("alike").select("_d", "at", full.alias("mask"))

    # stretches of a seed that differ: one occurrence of each stands for all
    kinds = shared.filter(~F.col("alike")).groupBy("seed", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("_d", "at")).alias("rep"))
    asked = kinds.select("seed", "stretch", "n", "rep._d", "rep.at").groupBy("_d", F.expr("shiftright(at, 38)").alias("_t")).agg(F.collect_list(F.struct("seed", "stretch", "n", "at")).alias("asked"))

    def extend(batches):
        for b in batches:
            parts = []
            for text, want in zip(common.texts_of(b.column(0)), b.column(1).to_pylist()):
                prefix = _prefix(hashed(text))
                for w in want:
                    first, more = divmod(w["at"] & ((1 << 38) - 1), 64)
                    a = np.arange(first, first + more + 1)
                    parts.append((w["seed"], w["stretch"], w["n"], _stretch(prefix, a, a + window).view(np.int64)))
            n = [len(p[3]) for p in parts]
            seed, stretch, times = (np.repeat(np.array([p[k] for p in parts], np.int64), n) for k in range(3))
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(k) for k in n)])
            hashes = np.concatenate([np.zeros(0, np.int64), *(p[3] for p in parts)])
            yield pa.record_batch([pa.array(x) for x in (seed, stretch, times, place.astype(np.int32), hashes)], ["seed", "stretch", "n", "i", "hash"])

    # rows that repeat each other answer alike, but their stretches count twice already
    windows = common.checkpoint(rows.join(asked, ["_d", "_t"]).select("text", "asked").mapInArrow(extend, "seed long, stretch long, n long, i int, hash long"))
    twice = windows.groupBy("seed", "hash").agg(F.sum("n").alias("times")).filter("times > 1").select("seed", "hash")
    masks = common.checkpoint(windows.join(twice, ["seed", "hash"]).groupBy("seed", "stretch").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask")))
    parts = shared.filter(~F.col("alike")).join(masks, ["seed", "stretch"]).select("_d", "at", "mask")
    first = F.expr("shiftright(at & 274877906943, 6)").alias("first")
    return whole.union(parts).groupBy("_d", F.expr("shiftright(at, 38)").alias("_t")).agg(F.collect_set(F.struct(first, "mask")).alias("marks"))


def remove_repeats(docs: DataFrame, window: int = 35, spread: int = 20) -> DataFrame:
    """All rows and columns of ``docs``, with n_words, n_removed, kept (the words left,
    joined by one blank) and spans (start and end of each maximal repeat, in words).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a run of ``window`` words
    covers it that also starts anywhere else, in its own document included, as judged on
    the input. A null text has no words; shorter texts lose none; rows that repeat each
    other lose what they share; an empty table gives none. Columns of ``docs`` by the
    names added here are replaced; names with a leading underscore are reserved.
    """
    common.small_batches(docs.sparkSession)
    added = {"n_words", "n_removed", "kept", "spans"}
    columns = [c for c in docs.columns if c not in added]
    marked = _keyed(docs.select(columns)).join(repeats(docs, window, spread).withColumnRenamed("marks", "_marks"), ["_d", "_t"], "left")
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches):
        for b in batches:
            out = []
            for text, marks in zip(common.texts_of(b.column(b.schema.get_field_index("_text"))), b.column(b.schema.get_field_index("_marks")).to_pylist()):
                a, z = common.word_spans(text)
                cover = np.zeros(len(a) + 1, dtype=np.int64)
                for m in marks or ():
                    for i in range(m["mask"].bit_length()):
                        if m["mask"] >> i & 1:
                            cover[m["first"] + i] += 1
                            cover[m["first"] + i + window] -= 1
                gone = np.cumsum(cover)[:-1] > 0
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                kept = b" ".join([text[x:y] for x, y in zip(a[~gone].tolist(), z[~gone].tolist())]).decode()
                out.append((len(a), int(gone.sum()), kept, [{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]))
            c = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in columns), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], kinds)], [*columns, "n_words", "n_removed", "kept", "spans"])

    schema = marked.select(columns).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string").add("spans", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer")))
    return marked.select(*columns, F.col("text").cast("string").alias("_text"), "_marks").mapInArrow(cut, schema)
