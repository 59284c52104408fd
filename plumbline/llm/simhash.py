"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Two fingerprints of B bytes that differ in at most r bits share at least B - r bytes in
the same position (the guaranteed minimum). Postings of a single byte would hold one row
in 256, so that pairs grow with the square of the input; the index therefore keys each
posting by several positions and their bytes. Position sets are chosen so that any
minimum of shared positions holds one of them whole (a Turan system); pairs that meet are
tallied over all positions, kept from the minimum on, and verified by their distance.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components


def guaranteed_sets(positions: int, least: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` positions such that any ``least`` of ``positions`` hold one.

    For sizes 3 of 4 Turan's construction in three cyclic groups; else all sets.
    """
    if (least, size) != (4, 3):
        return list(itertools.combinations(range(positions), size))
    group = [k * 3 // positions for k in range(positions)]

    def taken(t):
        count = [sum(group[x] == g for x in t) for g in range(3)]
        return 3 in count or any(count[g] == 2 and count[(g + 1) % 3] == 1 for g in range(3))

    return [t for t in itertools.combinations(range(positions), 3) if taken(t)]


def seeded_sets(positions: int, size: int, number: int, seed: int = 7) -> list[tuple[int, ...]]:
    """``number`` distinct position sets drawn at random, for radii without a guarantee."""
    rng = np.random.default_rng(seed)
    found: dict[tuple[int, ...], None] = {}
    while len(found) < number:
        found[tuple(sorted(rng.choice(positions, size, replace=False).tolist()))] = None
    return list(found)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """Bytes, high first, whose bits are set in over half the rows of a matrix of
    unsigned 64-bit hashes (rows x words); no rows: zero."""
    rows, words = hashes.shape
    if not rows:
        return np.zeros(8 * words, dtype=np.uint8)
    total = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, rows, 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)]).astype(">u8").view(np.uint8).reshape(-1, 8 * words)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return np.packbits(total * 2 > rows)


def shingle_fingerprint(text: bytes, words: int) -> bytes:
    """64 bits over XXH64 (seed 42) of the word shingles of a text, A-Z lower-cased,
    repeats included."""
    import xxhash

    parts = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return bytes(8)
    joined = b" ".join(parts)
    k = min(words, len(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())], dtype=np.uint64)
    return majority_bits(h[:, None]).tobytes()


def wide_fingerprint(text: bytes, words: int, bits: int) -> bytes:
    """``bits`` bits over independent 64-bit hashes of the word shingles."""
    text = text.lower()
    h = common.shingle_hashes(common.word_hashes(text, *common.word_spans(text)), words)
    keys = np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    return majority_bits(common.mix(h[:, None] + keys[None, :])).tobytes()


def fingerprints(docs: DataFrame, words: int = 5, bits: int = 64) -> DataFrame:
    """(doc_id, fp binary) of every row of ``docs`` (doc_id, text; others are ignored).

    64 bits: XXH64 of the shingles; more: derived hashes. A text of fewer words is one
    shingle; a null text or one without words has fingerprint zero.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = common.texts_of(b.column(1))
            fps = [shingle_fingerprint(t, words) if bits == 64 else wide_fingerprint(t, words, bits) for t in texts]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp binary")


def linked(left: np.ndarray, right: np.ndarray, radius: int, least: int) -> np.ndarray:
    """Which rows of ``right`` (n x bytes) the row ``left`` links: bytes shared in place
    are tallied first, and only rows that reach the minimum are verified by distance."""
    differ = right ^ left
    near = np.flatnonzero((differ == 0).sum(1) >= least)
    return near[np.bitwise_count(differ[near]).sum(1, dtype=np.int64) <= radius]


def bucket_edges(fps: np.ndarray, side: np.ndarray | None, radius: int, least: int) -> list[tuple[int, int]]:
    """Links that connect what the members of one bucket connect, at most one fewer than
    members: each member found opens its own search among those not yet found. With
    ``side`` (0 and 1) only links between the sides count."""
    edges: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            among = left if side is None else left[side[left] != side[at]]
            hit = among[linked(fps[at], fps[among], radius, least)]
            if len(hit):
                edges += [(at, int(x)) for x in hit]
                queue += hit.tolist()
                left = np.setdiff1d(left, hit, assume_unique=True)
    return edges


def bucket_runs(links_of, keys: tuple[str, ...], several: bool = False):
    """A function for mapInArrow over sorted rows: hands whole runs of equal ``keys`` to
    ``links_of`` (``several``: many at once) and yields the links (a, b) it returns."""

    def links_batch(e):
        return pa.record_batch([pa.array([x for x, _ in e], pa.int64()), pa.array([y for _, y in e], pa.int64())], ["a", "b"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            held, columns = t, [t.column(c).combine_chunks() for c in keys]
            change = np.logical_or.reduce([pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
            if len(cuts) > 1:
                done = t.slice(0, cuts[-1])
                for part in [done] if several else [done.slice(x, y - x) for x, y in zip(cuts, cuts[1:])]:
                    yield links_batch(links_of(part))
                held = t.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield links_batch(links_of(held))

    return run


def links(classes: DataFrame, radius: int, sets: list[tuple[int, ...]], least: int, block: int = 2048) -> DataFrame:
    """Links (a, b) that connect the classes (rep long, fp binary, distinct) as all links
    within the radius do.

    A bucket of more than ``block`` members is cut into blocks by hash, and each pair of
    blocks is searched in a group of its own, so no group exceeds twice a block.
    """
    index = F.explode(F.array(*[F.struct(F.lit(i).alias("set"), F.concat(*[F.substring("fp", p + 1, 1) for p in t]).alias("bytes")) for i, t in enumerate(sets)]))
    # the set and its bytes in one number, so that the index rows stay small
    width = len(sets[0])
    keyed = classes.select("rep", index.alias("k")).select("rep", (F.conv(F.hex("k.bytes"), 16, 10).cast("long") + F.col("k.set") * F.lit(256**width)).alias("key"))
    # most buckets hold one class: fingerprints join only those that meet another
    busy = common.checkpoint(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = keyed.join(common.merged(busy), "key").join(common.merged(classes), "rep")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    met = met.select("rep", "fp", "key", own.alias("own"), F.explode(others).alias("p"))

    def groups(fps, reps, own, cuts, j):
        """Links of each run of rows; runs of two, the most common, all at once."""
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        differ = fps[two] ^ fps[two + 1]
        ok = ((differ == 0).sum(1) >= least) & (np.bitwise_count(differ).sum(1, dtype=np.int64) <= radius) & ((own[two] != own[two + 1]) | (own[two] == j[two]) & (own[two + 1] == j[two]))
        found = list(zip(reps[two[ok]].tolist(), reps[two[ok] + 1].tolist()))
        for at, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            side = own[at : at + n]
            e = bucket_edges(fps[at : at + n], side if side.min() != side.max() else None, radius, least)
            found += [(int(reps[at + x]), int(reps[at + y])) for x, y in e]
        return found

    def found(t):
        """Links of whole runs of sorted rows."""
        marks = [t.column(c).to_numpy() for c in ("key", "i", "j")]
        cuts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([m[1:] != m[:-1] for m in marks]), [True]]))
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        return groups(fps, t.column("rep").to_numpy(), t.column("own").to_numpy(), cuts, marks[2])

    # groups are runs of sorted rows, so that many small ones cost no call each; the smallest
    # member opens each search, so that the buckets of a group yield the same few links
    dealt = met.select("rep", "fp", "key", "own", F.col("p.i").alias("i"), F.col("p.j").alias("j")).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    return dealt.mapInArrow(bucket_runs(found, ("key", "i", "j"), several=True), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 64, radius: int = 4, sets: list[tuple[int, ...]] | None = None, least: int | None = None) -> DataFrame:
    """(doc_id, fp binary, component_id) of every row: the smallest doc_id that links
    reach, itself included.

    Equal fingerprints form a class, represented by its smallest doc_id; the index holds
    one row per class, so copies are never expanded into pairs. Without ``sets`` the
    index is exact for radii below the number of bytes. Rows with a null doc_id form no
    links and have a null component; rows that repeat a doc_id share its component. An
    empty table gives none.
    """
    size = bits // 8
    least = size - radius if least is None else least
    if sets is None:
        if least < 1:
            raise ValueError("no shared byte is guaranteed at this radius: give position sets")
        sets = guaranteed_sets(size, least, min(3, least))
    found = common.stored(fingerprints(docs, words, bits), "fingerprints")
    classes = common.checkpoint(found.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges = links(classes, radius, sets, least)
    # a doc_id with several texts joins its classes
    several = found.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y").select("doc_id")
    same = found.join(common.merged(several), "doc_id").join(common.merged(classes), "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found_components = connected_components(edges.union(same))
    known = classes.join(common.merged(found_components), classes["rep"] == found_components["id"], "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    joined = found.join(common.merged(known), found["fp"] == known["_fp"], "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
