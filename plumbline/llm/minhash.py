"""MinHash document fingerprints, and near-duplicates by signature bands.

Permutations are multiply-add universal hashes modulo 2**64 of the hashes of word
shingles, all applied at once by numpy. A signature keeps, for each permutation, 16 mixed
bits of the least value, so two signatures agree in a place about as often as two sets
share an element (the Jaccard similarity), with a further chance of 2**-16.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .simhash import bucket_runs

PERMUTATIONS = 128
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Hashes of the runs of ``words`` words of a text (fewer: the whole sequence)."""
    return common.shingle_hashes(common.word_hashes(text, *common.word_spans(text)), words)


def signature(hashes: np.ndarray) -> np.ndarray:
    """uint16 signature of a set of shingle hashes; that of no shingles is all ones."""
    if not len(hashes):
        return np.full(PERMUTATIONS, 0xFFFF, dtype=np.uint16)
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 512):
        part = _A[:, None] * hashes[None, at : at + 512]
        part += _B[:, None]
        np.minimum(least, part.min(1), out=least)
    return (common.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of places in which two signatures agree: 0 to 1."""
    return float((a == b).mean())


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, given, doc_id, text) rows so that, in sorted partitions, every document
    is followed by the next one in descending doc_id; after the last comes the first.

    Ids are cut into ranges, each range goes to one task, and the first document of a
    range is also given to the range before it. Only one id per range reaches a join.
    Null ids come last; rows that repeat an id are ordered by their text.
    """
    spark = docs.sparkSession
    bounds = common.range_bounds(docs, "doc_id", min(4096, 2 * common.parts_for(spark)))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"), common.range_bucket("doc_id", bounds).alias("bucket"))
    firsts = sorted((r["bucket"], r["first"]) for r in rows.groupBy("bucket").agg(F.max("key").alias("first")).collect())
    after = [(b, first, firsts[(i + 1) % len(firsts)][0]) for i, (b, first) in enumerate(firsts)]
    gift = spark.createDataFrame(after or [(0, 0, 0)], "_b int, first long, receiver int")
    sent = rows.join(F.broadcast(gift), F.col("bucket") == F.col("_b"))  # one row per range
    to = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("given")))
    to = F.when(F.col("key") == F.col("first"), F.concat(to, F.array(F.struct(F.col("receiver").alias("bucket"), F.lit(1).alias("given"))))).otherwise(to)
    sent = sent.select("doc_id", "text", "key", F.explode(to).alias("to")).select("doc_id", "text", "key", "to.bucket", "to.given")
    return sent.repartition(common.parts_for(spark), "bucket").sortWithinPartitions("bucket", "given", F.desc("key"), "text")


def fingerprint_edits(docs: DataFrame, words: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last floor(n/2) code
    points are replaced by the first as many (or all) of the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex),
    near_edited, near_next. A null text counts as empty; a single document is its own
    next. Texts without words share one fingerprint. An empty table gives no rows.
    """
    common.small_batches(docs.sparkSession, 500)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        held = None  # (bucket, doc_id, text, signature) that waits for its next one
        filled = None  # the bucket whose gift has come
        for b in batches:
            out = []
            for doc_id, text, bucket, given in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "given"))):
                if given and filled == bucket:
                    continue
                sig = signature(shingles(text.encode(), words))
                if held is not None and held[0] == bucket:
                    n = len(held[2])
                    edited = held[2][: n - n // 2] + text[: n // 2]
                    raw = edited.encode()
                    esig = signature(shingles(raw, words))
                    out.append((held[1], n, hashlib.sha256(raw).hexdigest(), held[3].astype(">u2").tobytes().hex(), esig.astype(">u2").tobytes().hex(), likeness(held[3], esig), likeness(held[3], sig)))
                held, filled = (None, bucket) if given else ((bucket, doc_id, text, sig), filled)
            if out:
                c = list(zip(*out))
                yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.string()) for x in c[2:5]), *(pa.array(x, pa.float64()) for x in c[5:])], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs).select("doc_id", "text", "bucket", "given").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 20, rows: int = 6, block: int = 512) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id that links reach.

    Equal shingle sets form a class, represented by its smallest doc_id. Signature bands
    of the classes are joined in Spark; in each bucket the exact Jaccard similarity of the
    shingle sets is verified, in blocks, for links enough to connect what all links would.
    Texts without words are one class. Null ids have a null component; an empty table
    gives none.
    """
    common.small_batches(docs.sparkSession, 500)

    def sign(batches):
        for b in batches:
            sets = [np.unique(shingles(t, words)) for t in common.texts_of(b.column(1))]
            sigs = [signature(s).tobytes() for s in sets]
            keys = [[hashlib.blake2b(s[2 * rows * k : 2 * rows * (k + 1)] + bytes([k]), digest_size=8).digest() for k in range(bands)] for s in sigs]
            yield pa.record_batch([b.column(0), pa.array([hashlib.sha256(s.tobytes()).digest()[:16] for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.binary()))], ["doc_id", "cls", "hashes", "bands"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, "doc_id long, cls binary, hashes binary, bands array<binary>")
    found = common.stored(found, "signatures")
    reps = found.filter("doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    classes = reps.join(found.dropDuplicates(["cls", "doc_id"]).withColumnRenamed("cls", "_c"), (F.col("cls") == F.col("_c")) & (F.col("rep") == F.col("doc_id"))).select("rep", "hashes", "bands")
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    busy = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    met = keyed.join(busy, "key").select("rep", "key", own.alias("own"), F.explode(others).alias("p"))
    met = met.join(classes.select("rep", "hashes"), "rep").select("rep", "key", "own", "hashes", F.col("p.i").alias("i"), F.col("p.j").alias("j"))

    def links(t):
        sets = [np.frombuffer(x, "<u8") for x in t.column("hashes").to_pylist()]
        reps, side = t.column("rep").to_pylist(), t.column("own").to_pylist()
        apart = len(set(side)) > 1
        edges, left = [], list(range(len(sets)))
        while left:
            queue, left = [left[0]], left[1:]
            while queue and left:
                at, rest = queue.pop(), []
                for x in left:
                    shared = 0 if apart and side[x] == side[at] else len(np.intersect1d(sets[at], sets[x], assume_unique=True))
                    if shared and shared >= threshold * (len(sets[at]) + len(sets[x]) - shared):
                        edges.append((reps[at], reps[x]))
                        queue.append(x)
                    else:
                        rest.append(x)
                left = rest
        return edges

    dealt = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    edges = dealt.mapInArrow(bucket_runs(links, ("key", "i", "j")), "a long, b long").distinct()
    several = found.groupBy("doc_id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x <> y").select("doc_id")
    same = found.join(several, "doc_id").join(reps, "cls").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comps = connected_components(edges.union(same))
    known = reps.join(comps, reps["rep"] == comps["id"], "left").select(F.col("cls").alias("_c"), F.coalesce("component", "rep").alias("component_id"))
    joined = found.select("doc_id", "cls").join(known, F.col("cls") == F.col("_c"), "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
