"""SuperMinHash near-duplicates: signatures, bands, exact verification, union-find.

Each element of a set draws, level by level, the next place of its own random permutation
of the signature's places and a random fraction; a place keeps the least level plus
fraction of all elements. Because the places of one element are a permutation, they are
correlated, and the share of equal places of two signatures varies less about the Jaccard
similarity than with independent hashes. A value of a later level never replaces one of an
earlier level, so a set is done as soon as every place is filled: large sets need one or
two levels, a single element as many as there are places.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingle_join
from .components import connected_components

BANDS, ROWS = 40, 6
"""Two sets of similarity 0.85 share no band with a chance below (1 - 0.85**6)**40 = 6e-9."""

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(hashes: np.ndarray, sizes: np.ndarray, places: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (one row of ``places`` values for each set) of sets of distinct 64-bit
    hashes that lie one after the other, ``sizes`` of them each. A value is level << 32 |
    fraction; that of an empty set has all bits set in every place."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    best = np.full(len(sizes) * places, _EMPTY)
    swaps: list[np.ndarray] = []  # of each level so far: the place each element's shuffle took
    for level in range(places):
        if not len(hashes):
            break
        drawn = common.mix(hashes + np.arange(level + 1, level + 2, dtype=np.uint64) * common._R)
        taken = (np.uint64(level) + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(places - level) >> np.uint64(32))).astype(np.int16)
        place = taken
        for was in range(level - 1, -1, -1):  # what earlier levels of the shuffle left there
            place = np.where(place == swaps[was], np.int16(was), place)
        np.minimum.at(best, owner * places + place, np.uint64(level << 32) | drawn >> np.uint64(32))
        going = (best.reshape(-1, places) == _EMPTY).any(1)[owner]
        hashes, owner, swaps = hashes[going], owner[going], [s[going] for s in [*swaps, taken]]
    return best.reshape(-1, places)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of places in which two signatures agree: about the Jaccard similarity."""
    return float((a == b).mean())


def band_keys(signed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    part = signed[:, : bands * rows].reshape(-1, bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * common._R
    for r in range(rows):
        out = common.mix(out ^ part[:, :, r])
    return out


def forest(edges: DataFrame) -> DataFrame:
    """Links (a, b) enough to connect what ``edges`` (a long, b long) connect: each task
    unites its links by union-find and passes on one link for each id that is no root."""

    def unite(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
        ends = [(x, root(x)) for x in parent if parent[x] != x]
        for at in range(0, len(ends), 1 << 16):
            part = ends[at : at + (1 << 16)]
            yield pa.record_batch([pa.array([x for x, _ in part], pa.int64()), pa.array([y for _, y in part], pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(unite, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(85, 100), bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: the size of its set of
    distinct word shingles, the smallest doc_id that links reach (itself included), and
    whether that is its own.

    Sets are linked at an exact Jaccard similarity of ``threshold`` or more. Equal sets form
    a class, so that copies are never expanded into pairs; classes that share a band of
    their signatures are verified on their whole sets (``shingle_join.links``). A set so
    small that one element more or less takes it below the threshold is linked with equal
    ones only, and has no bands.

    A text of fewer words is one shingle. A null text, an empty one, and one without words
    have no shingle and are linked with nothing. Rows that repeat a doc_id are one document:
    they share a component, whatever their texts. A null doc_id takes part in no link, has a
    null component and is kept. An empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    least = next(n for n in range(1, 1 << 20) if Fraction(n, n + 1) >= threshold)

    def sign(batches):
        for b in batches:
            sets = [shingle_join.shingle_set(t, words) for t in common.texts_of(b.column(2))]
            sizes = np.array([len(s) for s in sets], np.int64)
            banded = np.flatnonzero(sizes >= least)
            keys = band_keys(signatures(np.concatenate([np.zeros(0, np.uint64), *(sets[x] for x in banded)]), sizes[banded], bands * rows), bands, rows)
            ends = np.cumsum(np.concatenate([[0], np.where(sizes >= least, bands, 0)])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
            own = [s.tobytes() if len(s) else b"no shingle of %d" % (d or 0) for s, d in zip(sets, b.column(0).to_pylist())]
            cls = pa.array([hashlib.sha256(x).digest()[:16] for x in own], pa.binary())
            yield pa.record_batch([b.column(0), b.column(1), cls, pa.array(sizes), pa.array([shingle_join.shingle_map(s).tobytes() for s in sets], pa.binary()), lists], ["doc_id", "tag", "cls", "size", "map", "keys"])

    found = common.stored(whole.mapInArrow(sign, "doc_id long, tag long, cls binary, size long, map binary, keys array<long>"), "signed")
    named = found.filter("doc_id is not null")
    classes = named.groupBy("cls").agg(F.min(F.struct("doc_id", "tag")).alias("rep"), *[F.first(c).alias(c) for c in ("size", "map", "keys")])
    classes = common.stored(classes.select("cls", "rep.doc_id", "rep.tag", "size", "map", "keys", F.monotonically_increasing_id().alias("id")), "classes")
    several = named.groupBy("doc_id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x <> y").select("doc_id")
    numbers = classes.select("cls", "id", F.col("doc_id").alias("low"))
    same = named.select("doc_id", "cls").join(several, "doc_id").join(numbers, "cls")
    same = same.groupBy("doc_id").agg(F.min("id").alias("a"), F.collect_set("id").alias("b")).select("a", F.explode("b").alias("b"))
    linked = shingle_join.links(classes.filter(F.size("keys") > 0), whole.filter("doc_id is not null"), words, threshold)
    components = connected_components(forest(linked.union(same)))
    grouped = numbers.join(components.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("cls", "low", F.coalesce("component", "id").alias("component"))
    lowest = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    known = common.checkpoint(grouped.join(lowest, "component").select("cls", "component_id"))
    met = named.select("doc_id", F.col("size").alias("n_shingles"), "cls").join(known, "cls")
    out = met.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    nameless = found.filter("doc_id is null").select("doc_id", F.col("size").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(nameless)
