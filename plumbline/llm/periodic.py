"""Periodic runs of words: stretches that repeat with a period, found by suffix classes.

Suffixes of the word sequence that share a beginning form classes. Classes are united in
descending order of their longest common prefix (Kruskal's order on the suffix array), by
union-find over position sets. When two sets are united, positions that become neighbours
in the united set, at a distance within the common prefix, seed a run: its period is the
distance, its end follows from the prefix, and its start by extending to the left.

Such neighbours find every run: of a run of smallest period q, its first position and the
one q words on share exactly the run's remaining length, and a position between them with
that beginning would give a smaller period. For the same reason no seed has a multiple of
a smallest period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


def prefix_ranks(words: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i]: a number of the 2**k words from i on, ordered as they are (a text that
    ends earlier comes first), by doubling until all differ."""
    n = len(words)
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    while ranks[-1].max() + 1 < n and 1 << len(ranks) - 1 < n:
        half = 1 << len(ranks) - 1
        after = np.zeros(n, dtype=np.int64)
        after[: n - half] = ranks[-1][half:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
    return ranks


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefix of the suffixes at a and at b, elementwise, a <> b."""
    n = len(ranks[0])
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + out, b + out
        fits = np.flatnonzero(np.maximum(x, y) + (1 << k) <= n)
        same = fits[ranks[k][x[fits]] == ranks[k][y[fits]]]
        out[same] += 1 << k
    return out


def seeds(words: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(first position, distance, common prefix) of positions that become neighbours, at a
    distance within their common prefix, of ``shortest`` words or more."""
    ranks = prefix_ranks(words)
    order = np.argsort(ranks[-1], kind="stable")
    lcp = common_prefix(ranks, order[:-1], order[1:])
    links = np.flatnonzero(lcp >= shortest)
    links = links[np.argsort(-lcp[links], kind="stable")]
    parent, members = {}, {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    joins = []  # (common prefix, positions of the smaller set): what was united, in order
    for x, y, length in zip(order[links].tolist(), order[links + 1].tolist(), lcp[links].tolist()):
        x, y = root(x), root(y)
        big, small = members.setdefault(x, [x]), members.setdefault(y, [y])
        if len(big) < len(small):
            x, y, big, small = y, x, small, big
        parent[y] = x
        joins.append((length, small))
        big += small
        del members[y]
    # backwards, each set is a list linked in order, from which the smaller set is taken
    # out again: who its neighbours are is known without search
    before, after = {}, {}
    for found in members.values():
        found = sorted(found)
        before.update(zip(found[1:], found))
        after.update(zip(found, found[1:]))
    out = []
    for length, small in reversed(joins):
        inside = sorted(small)
        own = set(inside)
        for at in inside:
            left, right = before.get(at), after.get(at)
            if left is not None and at - left <= length and left not in own:
                out.append((left, at - left, length))
            if right is not None and right - at <= length and right not in own:
                out.append((at, right - at, length))
        for at in inside:
            left, right = before.pop(at, None), after.pop(at, None)
            if left is not None:
                after.pop(left, None) if right is None else after.__setitem__(left, right)
            if right is not None:
                before.pop(right, None) if left is None else before.__setitem__(right, left)
        before.update(zip(inside[1:], inside))
        after.update(zip(inside, inside[1:]))
    return out


def leftmost(words: np.ndarray, at: int, period: int) -> int:
    """The smallest start from which words up to ``at`` equal those ``period`` words on."""
    step = 64
    while at:
        low = max(0, at - step)
        differ = np.flatnonzero(words[low:at] != words[low + period : at + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        at, step = low, 2 * step
    return 0


def runs(words: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period: stretches of words of
    smallest period q, at least max(least, 2 * q) long, that no neighbour extends.

    ``words`` are numbers, equal for equal words.
    """
    shortest = (least + 1) // 2  # of a run that long, more than this follows its first period
    if len(words) < max(least, 2):
        return []
    window = common.shingle_hashes(common.mix(words.astype(np.uint64)), shortest)
    window.sort()
    if not (window[1:] == window[:-1]).any():  # nothing that long stands twice
        return []
    ends: dict[tuple[int, int], int] = {}
    for at, period, length in seeds(words, shortest):
        key = (period, at + period + length)
        ends[key] = min(at, ends.get(key, at))
    found = ((leftmost(words, at, period), end, period) for (period, end), at in ends.items())
    return sorted((start, end - start, period) for start, end, period in found if end - start >= least)


def covered(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] > 0


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """All rows and columns of ``docs``, with n_words, runs (structs of start, length and
    period, by start, then period; no run: empty) and collapsed (the words that no run
    repeats, joined by one blank).

    Words are ``[^\\x20\\x09-\\x0D]+`` of ``text``, unchanged. A null text has no words.
    Each row is judged by itself, so repeated rows answer alike; an empty table gives none.
    Columns of ``docs`` by the names added here are replaced; names with a leading
    underscore are reserved.
    """
    common.small_batches(docs.sparkSession)
    if least < 2:
        raise ValueError("a run has two words at least")
    columns = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches):
        for b in batches:
            out = []
            for text in common.texts_of(b.column(len(columns))):
                words = text.split()  # bytes: ASCII white space only
                numbers: dict[bytes, int] = {}
                found = runs(np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64), least)
                if found:
                    words_left = [w for w, gone in zip(words, covered(found, len(words)).tolist()) if not gone]
                else:
                    words_left = words
                out.append((len(words), [{"start": s, "length": n, "period": p} for s, n, p in found], b" ".join(words_left).decode()))
            c = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in range(len(columns))), pa.array(c[0], pa.int64()), pa.array(c[1], kinds), pa.array(c[2], pa.string())], [*columns, "n_words", "runs", "collapsed"])

    run = T.StructType().add("start", "long").add("length", "long").add("period", "long")
    given = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    return given.mapInArrow(search, docs.select(*columns).schema.add("n_words", "long").add("runs", T.ArrayType(run)).add("collapsed", "string"))
