"""Near-duplicates by the exact Jaccard similarity of shingle sets: a prefix-filter join.

All shingles stand in one order, rare ones first. Two sets of similarity t share at least
t * n shingles, whichever of them has the n; so the first n - ceil(t * n) + 1 shingles of
the one and of the other (their prefixes) hold one in common. The index has a row per
shingle of a prefix. Classes that meet in it are compared by bit maps of their sets, which
never reject a pair at the threshold, and the pairs left by the whole sets. No pair at the
threshold or above is missed, and none below it is linked.

Before that join the classes are searched by SimHash (``simhash_links``); what it links is
verified on the whole sets and then stands as known, and the join looks only for links
between what is not yet connected.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .minhash import shingles
from .simhash import bucket_runs, guaranteed_sets, majority_bits
from .simhash import links as fingerprint_links

SAMPLE, HOT = 65_536, 1 << 18
"""Documents (about) whose shingles are counted for the order, and the most shingles that
go last. They decide which shingles are indexed, never which pairs are found."""

RADIUS = 4
"""Differing bits of 64 that SimHash's index finds without loss: four bytes are then equal
in place. Pairs at 0.8 differ in ten on average, so the join must follow."""

SMALL = 16
"""Members of a bucket of which all pairs are verified."""

LONGEST = 8192
"""Bits of the longest map. Shorter maps reject fewer pairs, and never one at the threshold."""


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Ascending hashes of the word shingles of a text, A-Z lower-cased."""
    return np.unique(shingles(text.lower(), words))


def prefix(found: np.ndarray, hot: np.ndarray, rank: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The first shingles of a set: by hash, the ``hot`` ones (ascending) last, by rank."""
    n = len(found)
    if not n:
        return found
    most = n + int(-n * threshold // 1) + 1  # n - ceil(threshold * n) + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        late = hot[at] == found
        found = np.concatenate([found[~late], found[late][np.argsort(rank[at[late]])]])
    return found[:most]


def alike(left: np.ndarray, others: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Which of the ``others`` reach the threshold with ``left``; no set is empty."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    met = left[np.minimum(np.searchsorted(left, every), len(left) - 1)] == every
    shared = np.add.reduceat(met.astype(np.int64), np.cumsum(sizes) - sizes)
    return shared * threshold.denominator >= threshold.numerator * (len(left) + sizes - shared)


def shingle_map(found: np.ndarray) -> np.ndarray:
    """A bit map of a set, as bytes: a power of two of bits, at least four for a shingle,
    and LONGEST at most, so that rows of the index stay small."""
    bits = np.zeros(min(LONGEST, max(64, 1 << (4 * len(found) - 1).bit_length())) if len(found) else 64, dtype=bool)
    bits[found & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits)


def map_filter(size: np.ndarray, maps: list[bytes], threshold: Fraction):
    """near(at, among): those of ``among`` that sizes and maps do not prove to be below the
    threshold with ``at``: maps differ in no more bits than sets in shingles."""
    up, down = threshold.numerator, threshold.denominator
    width = np.array([len(m) for m in maps])
    place, table = np.zeros(len(maps), dtype=np.int64), {}
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        place[own], table[w] = np.arange(len(own)), np.frombuffer(b"".join(maps[x] for x in own), np.uint8).reshape(-1, w)

    def folded(m: np.ndarray, w: int) -> np.ndarray:
        while m.shape[1] > w:
            m = m[:, : m.shape[1] // 2] | m[:, m.shape[1] // 2 :]
        return m

    def near(at: int, among: np.ndarray) -> np.ndarray:
        among = among[np.minimum(size[among], size[at]) * down >= np.maximum(size[among], size[at]) * up]
        hits = []
        for w in np.unique(width[among]).tolist():
            x, least = among[width[among] == w], min(w, int(width[at]))
            mine = folded(table[int(width[at])][place[at]][None, :], least)
            differ = np.bitwise_count(folded(table[w][place[x]], least) ^ mine).sum(1, dtype=np.int64)
            hits.append(x[differ * (down + up) <= (size[x] + size[at]) * (down - up)])
        return np.concatenate(hits) if hits else among

    return near


def bucket_pairs(size: np.ndarray, maps: list[bytes], side: np.ndarray | None, known: np.ndarray, threshold: Fraction) -> list[tuple[int, int]]:
    """All pairs of members of a bucket with different ``known`` numbers that
    ``map_filter`` leaves. With ``side`` only pairs between the sides."""
    near, out = map_filter(size, maps, threshold), []
    for at in range(len(maps) - 1):
        after = np.arange(at + 1, len(maps))
        after = after[(known[after] != known[at]) & (side is None or side[after] != side[at])]
        out += [(at, int(x)) for x in near(at, after)] if len(after) else []
    return out


def group_links(sets: list[np.ndarray], known: np.ndarray, threshold: Fraction) -> list[tuple[int, int]]:
    """Pairs that reach the threshold and connect what all such pairs would, given that
    members of one ``known`` number are connected, which are not compared."""
    near = map_filter(np.array([len(s) for s in sets]), [shingle_map(s).tobytes() for s in sets], threshold)
    label, edges = np.unique(known, return_inverse=True)[1], []
    for at in range(len(sets) - 1):
        after = np.arange(at + 1, len(sets))
        after = after[label[after] != label[at]]
        left = near(at, after) if len(after) else after
        while len(left):
            part, left = left[:16], left[16:]
            for x in part[alike(sets[at], [sets[x] for x in part], threshold)].tolist():
                if label[x] != label[at]:
                    edges.append((at, x))
                    label[label == label[x]] = label[at]
            left = left[label[left] != label[at]]
    return edges


def hot_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, rank of each) of shingles that several documents of a sample
    share, rank 0 the rarest: at most HOT."""
    share = F.lit(max(1, -(-docs.count() // SAMPLE)))

    def run(batches):
        for b in batches:
            found = [shingle_set(t, words) for t in common.texts_of(b.column(0))]
            if found:
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], ["key"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "tag"), share) == 0).select(F.col("text").cast("string"))
    counted = sample.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 2")
    top = counted.orderBy(F.desc("n"), "key").limit(HOT).toPandas()
    hashes = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], len(top) - 1 - order


def candidates(dealt: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b; a < b) that sizes and maps leave of the groups (key, i, j) of rows
    (id, size, map, own, known): between different ``known`` numbers, and where i and j
    differ only between the blocks ``own``."""
    up, down = threshold.numerator, threshold.denominator

    def found(t):
        ids, size, own, known, *marks = (t.column(c).to_numpy() for c in ("id", "size", "own", "known", "key", "i", "j"))
        cuts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([m[1:] != m[:-1] for m in marks]), [True]]))
        most, least = np.maximum.reduceat(size, cuts[:-1]), np.minimum.reduceat(size, cuts[:-1])
        runs = np.diff(cuts)
        out = []
        for k in np.flatnonzero((runs > 2) | (runs == 2) & (least * down >= most * up)).tolist():
            part = slice(cuts[k], cuts[k + 1])
            side = own[part] if marks[1][cuts[k]] != marks[2][cuts[k]] else None
            maps = t.column("map").slice(cuts[k], runs[k]).to_pylist()
            out += [tuple(sorted((int(ids[cuts[k] + x]), int(ids[cuts[k] + y])))) for x, y in bucket_pairs(size[part], maps, side, known[part], threshold)]
        return out

    dealt = dealt.select("id", "size", "key", "own", "known", "map", "i", "j").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return dealt.mapInArrow(bucket_runs(found, ("key", "i", "j"), several=True), "a long, b long").distinct()


def whole_sets(ids: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(id, hashes) of the classes ``ids`` (id, distinct), once each."""

    def whole(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([shingle_set(t, words).tobytes() for t in common.texts_of(b.column(1))], pa.binary())], ["id", "hashes"])

    wanted = classes.select("id", "doc_id", "tag").join(common.merged(ids), "id")
    sets = texts.join(common.merged(wanted), ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"]).select("id", "text").mapInArrow(whole, "id long, hashes binary")
    return common.stored(sets, "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Those of the pairs (a, b) whose whole ``sets`` (id, hashes) reach the threshold."""

    def compare(batches):
        for b in batches:
            pair = [[np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in (2, 3)]
            ok = [bool(alike(x, [y], threshold)[0]) for x, y in zip(*pair)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = (common.merged(sets.select(F.col("id").alias(c), F.col("hashes").alias(h))) for c, h in (("a", "x"), ("b", "y")))
    return common.checkpoint(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))


def cluster_links(members: DataFrame, sets: DataFrame, threshold: Fraction, block: int, seed: int) -> DataFrame:
    """Verified links of rows (id, cluster, known) of a cluster, dealt by hash into blocks
    of about ``block``, within each block."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = members.join(common.merged(sizes), "cluster").select("id", "cluster", "known", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).alias("own"))

    def found(t):
        ids = t.column("id").to_numpy()
        hashes = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        return [(int(ids[x]), int(ids[y])) for x, y in group_links(hashes, t.column("known").to_numpy(), threshold)]

    dealt = dealt.join(common.merged(sets), "id").repartition("cluster", "own").sortWithinPartitions("cluster", "own", "id")
    return common.checkpoint(dealt.mapInArrow(bucket_runs(found, ("cluster", "own")), "a long, b long"))


def simhash_links(classes: DataFrame, texts: DataFrame, words: int, threshold: Fraction, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the classes (id, fp, ...) that SimHash finds and whose whole
    sets reach the threshold: fingerprints of eight bytes that differ in at most ``radius``
    bits share 8 - radius bytes in place, by which they are indexed, tallied and kept.

    Classes of one fingerprint are linked to the smallest of them.
    """
    rep = F.min("id").alias("rep")
    prints = common.stored(classes.filter("size > 0").groupBy("fp").agg(rep, F.count("*").alias("n")), "fingerprints")
    near = fingerprint_links(prints.select("rep", "fp"), radius, guaranteed_sets(8, 8 - radius, min(3, 8 - radius)), 8 - radius)
    same = classes.filter("size > 0").join(common.merged(prints.filter("n > 1")), "fp").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    pairs = common.stored(near.union(same), "near")
    sets = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), classes, texts, words)
    return verified(pairs, sets, threshold)


def links(classes: DataFrame, texts: DataFrame, words: int, threshold: Fraction, block: int = 512, first: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that connect the classes (id, doc_id, tag, size, map, keys: prefixes or
    bands) as all links of classes that share a key do; ``texts`` (doc_id, tag, text) holds
    their texts.

    ``first``: verified links (a, b) known before, such as SimHash's. They are the first
    edges; what they connect is not compared again.

    Buckets of the same members are searched once. In those of up to SMALL members all
    pairs that sizes and maps leave are verified. Larger buckets that overlap form a
    cluster. Its rows, with their whole sets, are searched in blocks for links between
    what is not yet connected; then one row of each connected part is dealt into new
    blocks, as long as that halves their number, so that a large group of near copies
    comes together in a few rounds. Where a larger bucket then still holds several
    connected parts, all pairs between these that sizes and maps leave are verified too,
    each two blocks of the bucket in a group of their own.
    """
    keyed = classes.select("id", F.explode("keys").alias("key"))
    members = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    busy = common.stored(members.filter("n > 1").groupBy("n", "low", "high", "x", "y").agg(F.min("key").alias("key")).select("key", "n", "low"), "busy")
    met = common.stored(keyed.join(common.merged(busy), "key").select("id", "key", "n", "low"), "met")
    maps = common.merged(classes.select("id", "size", "map"))
    zero = F.lit(0)
    small = met.filter(F.col("n") <= SMALL).withColumn("known", F.col("id"))
    if first is not None:
        joined = connected_components(first).select(F.col("id").alias("_id"), F.col("component").alias("_known"))
        small = small.join(common.merged(joined), F.col("id") == F.col("_id"), "left").withColumn("known", F.coalesce("_known", "id"))
    small = small.select("id", "key", "known", zero.alias("own"), zero.alias("i"), zero.alias("j"))
    pairs = common.stored(candidates(small.join(maps, "id"), threshold), "pairs")
    large = met.filter(F.col("n") > SMALL)
    sets = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(large.select("id")).distinct(), classes, texts, words)
    edges = verified(pairs, sets, threshold)
    edges = edges if first is None else common.checkpoint(first.union(edges))
    if not large.limit(1).count():
        return edges
    clusters = connected_components(large.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("component", "cluster")

    def parts(edges: DataFrame) -> DataFrame:
        """(id, cluster, known) as the edges so far connect them."""
        joined = connected_components(edges).withColumnRenamed("id", "_id")
        return common.checkpoint(clusters.join(common.merged(joined), F.col("id") == F.col("_id"), "left").select("id", "cluster", F.coalesce("component", "id").alias("known")))

    rows = members = clusters.withColumn("known", F.col("id"))
    was, seed = rows.count(), 0
    while True:
        edges = common.checkpoint(edges.union(cluster_links(rows, sets, threshold, block, seed)))
        members, seed = parts(edges), seed + 1
        rows = members.groupBy("cluster", "known").agg(F.min("id").alias("id"))
        now = rows.count()
        if 2 * now > was:
            break
        was = now
    blocks = F.ceil(F.col("n") / (4 * block)).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
    rest = large.join(common.merged(members.select("id", "known")), "id").withColumn("blocks", blocks).withColumn("own", own)
    mixed = rest.groupBy("key").agg((F.min("known") < F.max("known")).alias("mixed")).filter("mixed").select("key")
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    rest = common.checkpoint(rest.join(common.merged(mixed), "key")).select("id", "key", "known", "own", F.explode(both).alias("p")).select("id", "key", "known", "own", "p.i", "p.j")
    pairs = common.stored(candidates(rest.join(maps, "id"), threshold), "pairs")
    return common.checkpoint(edges.union(verified(pairs, sets, threshold)))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5), block: int = 512) -> DataFrame:
    """(doc_id, tag, component_id) of every row with a doc_id: a number of what links reach.

    ``tag`` is a 64-bit hash of the row's text (null: empty), so that rows which repeat a
    doc_id with other texts stay apart. Equal shingle sets form a class, so that copies are
    never expanded into pairs; texts without words are one class. An empty table gives none.
    """
    common.small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    hot, rank = hot_shingles(rows, words)

    def sign(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in common.texts_of(b.column(2))]
            keys = [prefix(s, hot, rank, threshold) for s in sets]
            ends = np.cumsum([0, *(len(k) for k in keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array([hashlib.sha256(s.tobytes()).digest()[:16] for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([shingle_map(s).tobytes() for s in sets], pa.binary()), pa.array([majority_bits(s[:, None]).tobytes() for s in sets], pa.binary()), lists], ["doc_id", "tag", "cls", "size", "map", "fp", "keys"])

    found = common.stored(rows.mapInArrow(sign, "doc_id long, tag long, cls binary, size long, map binary, fp binary, keys array<long>"), "prefixes")
    classes = found.groupBy("cls").agg(F.min(F.struct("doc_id", "tag")).alias("rep"), *[F.first(c).alias(c) for c in ("size", "map", "fp", "keys")])
    classes = common.stored(classes.select("cls", "rep.doc_id", "rep.tag", "size", "map", "fp", "keys", F.monotonically_increasing_id().alias("id")), "classes")
    first = simhash_links(classes, rows, words, threshold)
    components = connected_components(links(classes, rows, words, threshold, block, first))
    known = classes.select("cls", F.col("id").alias("_id")).join(common.merged(components), F.col("_id") == F.col("id"), "left").select("cls", F.coalesce("component", "_id").alias("component_id"))
    return found.select("doc_id", "tag", "cls").join(common.merged(known), "cls").select("doc_id", "tag", "component_id")
