"""SentencePiece encoding and decoding over a lattice of pieces.

A text is marked as the model asks (a mark before it and for every blank) and cut into
words before each mark that follows another character; no piece crosses such a cut. The
distinct words of a batch of texts are laid one after another; their substrings, ever
longer, are joined to the piece table's beginnings, and those that are pieces are the
lattice's edges, folded for many words at once by numpy. What a task holds is bounded by
its batch, what a fold holds by a lot of its characters; no word leaves its task.

Objective "viterbi" folds for the best sum of scores, as unigram models do: edges come by
their end, and each extends the best segmentation up to its start. The scores of a
byte-pair model are merge orders, whose best sum is another segmentation than the model's
own; for the model's own ids "merges" joins, in each word, the two neighbouring symbols
whose piece has the best score (of equal ones the first), until no two make a piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"


def piece_table(spark: SparkSession, model_file: str) -> DataFrame:
    """(piece, id, score, kind) of a model; kind: normal, byte, control or unknown.
    Bounded by the vocabulary, so it may be broadcast."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kinds = ["unknown" if m.is_unknown(i) else "control" if m.is_control(i) else "byte" if m.is_byte(i) else "normal" for i in range(m.get_piece_size())]
    rows = [(m.id_to_piece(i), i, float(m.get_score(i)), k) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "piece string, id int, score double, kind string")


UNKNOWN_COST = 1e10
"""Of a character in no piece, so that it stands alone only where no piece covers it."""

SHORT = 60
"""Longer words are cut where two neighbours stand together in no piece: no edge of the
lattice crosses such a place, so a word's ids are those of its parts, one after another."""


LOT = 1 << 16
"""Characters folded at once, and words whose ids are put in their places at once, about;
a part that nothing cuts is folded whole, however long."""


def _lots(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Runs (from, to) of neighbours whose sizes sum to ``limit``, about."""
    lot = np.cumsum(sizes) // limit
    cuts = [*np.flatnonzero(np.diff(lot, prepend=-1)).tolist(), len(lot)]
    return list(zip(cuts, cuts[1:]))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in ascending ``keys``, -1 for what is not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Pieces:
    """A piece table as arrays. Symbols are the normal pieces and the single characters in
    them; beginnings of pieces are numbered by length, keyed by what they extend."""

    def __init__(self, rows: list):
        normal = [r for r in rows if r["kind"] == "normal" and r["piece"]]
        byte = [r["id"] for r in rows if r["kind"] == "byte" and r["piece"] == "<0x00>"]
        self.base = byte[0] if byte else None
        self.unknown = next((r["id"] for r in rows if r["kind"] == "unknown"), 0)
        names = {r["piece"]: k for k, r in enumerate(normal)}
        score = [r["score"] for r in normal]
        self.ids = [r["id"] for r in normal]
        for c in sorted({c for r in normal for c in r["piece"]} - names.keys()):
            names[c] = len(names)
            score.append(-UNKNOWN_COST)
            self.ids.append(-1)
        self.ids = np.array([*self.ids, -1], dtype=np.int64)  # the last: a character in no piece
        self.cost = -np.array([*score, -UNKNOWN_COST])
        self.order = np.unique(self.cost, return_inverse=True)[1].astype(np.int64)
        # beginnings: level by level, (beginning before) * 2**21 + next character
        level, self.levels = {"": 0}, []
        for n in range(1, max(map(len, names), default=0) + 1):
            made = sorted((level[x[:-1]] << 21 | ord(x[-1]), x) for x in {x[:n] for x in names if len(x) >= n})
            level = {x: k for k, (_, x) in enumerate(made)}
            self.levels.append((np.array([k for k, _ in made], dtype=np.int64), np.array([names.get(x, -1) for _, x in made], dtype=np.int64)))
        pairs = sorted((names[x[:k]] << 32 | names[x[k:]], names[x]) for x in names for k in range(1, len(x)) if x[:k] in names and x[k:] in names)
        self.pairs, self.joined = np.array([k for k, _ in pairs], dtype=np.int64), np.array([x for _, x in pairs], dtype=np.int64)
        self.together = np.array(sorted({ord(a) << 21 | ord(b) for x in names for a, b in zip(x, x[1:])}), dtype=np.int64)

    def encode(self, words: pa.Array, objectives: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each objective (ids of all ``words``, one after another; where each word's
        begin, and their end)."""
        text = "".join(words.to_pylist())
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(size) - size
        cut = np.zeros(len(chars) + 1, dtype=bool)
        cut[first] = cut[-1] = True
        inner = np.flatnonzero(np.repeat(size > SHORT, size) & ~cut[:-1])
        for x in range(0, len(inner), LOT):
            i = inner[x : x + LOT]
            cut[i] = _find(self.together, chars[i - 1].astype(np.int64) << 21 | chars[i]) < 0
        parts = np.flatnonzero(cut)
        got = [[(parts[:0], parts[:0])] for _ in objectives]
        for x, y in _lots(np.diff(parts), LOT):
            some = chars[parts[x] : parts[y]].astype(np.int64)
            single = _find(self.levels[0][0], some) if self.levels else np.full(len(some), -1)
            symbol = np.where(single >= 0, self.levels[0][1][single], -1) if self.levels else single
            for objective, own in zip(objectives, got):
                starts, found = OBJECTIVES[objective](self, some, single, symbol, parts[x : y + 1] - parts[x])
                own.append((starts + parts[x], found))
        return [self._ids_of(chars, *map(np.concatenate, zip(*own)), np.append(first, len(chars))) for own in got]

    def _ids_of(self, chars, starts, found, bounds):
        ids = self.ids[found]
        lost = np.flatnonzero(ids < 0)
        n = np.ones(len(ids), dtype=np.int64)
        if self.base is None:
            ids[lost] = self.unknown
        else:
            c = chars[starts[lost]]
            n[lost] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        at = np.append(0, np.cumsum(n))
        out = np.repeat(ids, n)
        if self.base is not None:
            for x in np.unique(c).tolist():
                for k, b in enumerate(chr(x).encode()):
                    out[at[lost[c == x]] + k] = self.base + b
        return out.astype(np.int32), at[np.searchsorted(starts, bounds)]


def _edges(pieces: Pieces, chars: np.ndarray, single: np.ndarray, symbol: np.ndarray, parts: np.ndarray):
    """All pieces in the parts: (start, length, symbol). A character in no piece is an edge
    of its own."""
    end = np.repeat(parts[1:], np.diff(parts))
    found = [(np.arange(len(chars)), np.ones(len(chars), np.int64), symbol)]
    start, node = np.flatnonzero(single >= 0), single[single >= 0]
    for n, (keys, names) in enumerate(pieces.levels[1:], 2):
        inside = start + n <= end[start]
        start, node = start[inside], node[inside]
        node = _find(keys, node << 21 | chars[start + n - 1])
        start, node = start[node >= 0], node[node >= 0]
        whole = names[node] >= 0
        found.append((start[whole], np.full(int(whole.sum()), n), names[node[whole]]))
    return tuple(map(np.concatenate, zip(*found)))


def _best_cuts(pieces: Pieces, chars: np.ndarray, single: np.ndarray, symbol: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, symbols) of the segmentation of least cost. Ties go to the longest last piece."""
    start, size, name = _edges(pieces, chars, single, symbol, parts)
    of = np.repeat(np.arange(len(parts) - 1), np.diff(parts))
    longest = len(pieces.levels) + 1
    # by their ends, for all parts at once; of one end, longest first
    key = (start + size - parts[of[start]]) * (longest + 1) + longest - size
    order = np.argsort(key, kind="stable")
    start, size, name, key = start[order], size[order], name[order], key[order]
    slot = start + of[start]  # a part of n characters has n + 1 places
    cost = pieces.cost[name]
    best = np.full(len(chars) + len(parts), np.inf)
    best[parts[:-1] + np.arange(len(parts) - 1)] = 0
    last = np.zeros(len(best), dtype=np.int64)
    steps = np.flatnonzero(np.diff(key, prepend=-1)).tolist()
    for a, b in zip(steps, [*steps[1:], len(key)]):
        new, to = best[slot[a:b]] + cost[a:b], slot[a:b] + size[a:b]
        better = np.flatnonzero(new < best[to])
        best[to[better]] = new[better]
        last[to[better]] = a + better
    begins, found = np.zeros(len(chars), dtype=bool), np.zeros(len(chars), dtype=np.int64)
    at = parts[1:] + np.arange(len(parts) - 1)
    floor = parts[:-1] + np.arange(len(parts) - 1)
    while len(at):
        edge = last[at]
        begins[start[edge]], found[start[edge]] = True, name[edge]
        at = at - size[edge]
        at, floor = at[at > floor], floor[at > floor]
    starts = np.flatnonzero(begins)
    return starts, found[starts]


def _merge_cuts(pieces: Pieces, chars: np.ndarray, single: np.ndarray, symbol: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, symbols) of the model's own merges."""
    begins, found = np.ones(len(chars), dtype=bool), symbol.copy()
    at, name, of = np.arange(len(chars)), symbol.copy(), np.repeat(np.arange(len(parts) - 1), np.diff(parts))

    def made(k):
        """What symbols k and the next one make, -1 for nothing."""
        out = np.full(len(k), -1)
        fits = np.flatnonzero(k + 1 < len(name))
        fits = fits[(of[k[fits]] == of[k[fits] + 1]) & (name[k[fits]] >= 0) & (name[k[fits] + 1] >= 0)]
        pair = _find(pieces.pairs, name[k[fits]] << 32 | name[k[fits] + 1])
        out[fits] = np.where(pair >= 0, pieces.joined[pair], -1) if len(pieces.joined) else -1
        return out

    pair = made(np.arange(len(name)))
    none = np.int64(1) << 62
    while len(name):
        rank = np.where(pair >= 0, pieces.order[pair] << 32 | np.arange(len(pair)), none)
        head = np.flatnonzero(np.diff(of, prepend=-1))
        best = np.minimum.reduceat(rank, head)
        going = best < none
        k = best[going] & 0xFFFFFFFF
        if not len(k):
            break
        name[k] = pair[k]
        found[at[k]] = pair[k]
        begins[at[k + 1]] = False
        keep = np.repeat(going, np.diff(head, append=len(of)))  # words without a pair are done
        keep[k + 1] = False
        moved = (np.cumsum(keep) - 1)[k]
        at, name, of, pair = at[keep], name[keep], of[keep], pair[keep]
        before = moved[moved > 0] - 1
        for again in (moved, before):
            pair[again] = made(again)
    starts = np.flatnonzero(begins)
    return starts, found[starts]


OBJECTIVES = {"viterbi": _best_cuts, "merges": _merge_cuts}


def _shared(pieces: DataFrame, objectives: tuple[str, ...]):
    if not objectives or set(objectives) - set(OBJECTIVES):
        raise ValueError("objectives: viterbi, merges")
    return pieces.sparkSession.sparkContext.broadcast(Pieces(pieces.select("piece", "id", "score", "kind").orderBy("id").collect()))  # bounded by the vocabulary


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def _schema(key: str, objectives: tuple[str, ...]) -> T.StructType:
    out = T.StructType().add(key, "string" if key == "word" else "long")
    for name in ("ids", *objectives[1:]):
        out = out.add(name, T.ArrayType(T.IntegerType()))
    return out


def encode_words(words: DataFrame, pieces: DataFrame, objectives: tuple[str, ...] = ("viterbi",)) -> DataFrame:
    """(word, ids) of ``words``, by the first objective; those of further ones are columns
    of their names. Characters in no piece give their UTF-8 bytes' pieces, or the unknown
    one where the model has none."""
    shared = _shared(pieces, objectives)

    def code(batches):
        for b in batches:
            word = pc.fill_null(b.column(0), "")
            yield pa.RecordBatch.from_arrays([word, *(_lists(*x) for x in shared.value.encode(word, objectives))], ["word", "ids", *objectives[1:]])

    return words.select("word").mapInArrow(code, _schema("word", objectives))


def marked_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, each with its marks in front; how many each text has). An
    empty text has none."""
    texts = texts.cast(pa.large_string())
    marked = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), pc.replace_substring(texts, " ", MARK), pa.scalar("", pa.large_string()))).cast(pa.large_string())
    if not len(marked):
        return marked, np.zeros(0, np.int64)
    _, offsets, raw = marked.buffers()
    at = np.frombuffer(offsets, np.int64)[marked.offset : marked.offset + len(marked) + 1]
    raw = raw.slice(at[0], at[-1] - at[0]) if raw else pa.py_buffer(b"")
    at = at - at[0]
    data = np.frombuffer(raw, np.uint8)
    a, b, c = MARK.encode()
    mark = np.flatnonzero(data[:-2] == a)
    mark = mark[(data[mark + 1] == b) & (data[mark + 2] == c)]
    begins = np.zeros(len(data), dtype=bool)
    begins[mark[np.diff(mark, prepend=-4) != 3]] = True
    begins[at[:-1][np.diff(at) > 0]] = True  # also behind a text that ends with a mark
    start = np.flatnonzero(begins)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data))), raw)
    return words, np.diff(np.searchsorted(start, at))


def _texts(column: pa.Array) -> pa.Array:
    """A string column as Spark gives it (null: empty); of what is no UTF-8 the characters
    in place that Python gives it."""
    try:
        return pc.fill_null(column.cast(pa.binary()).cast(pa.string()), "").cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in common.texts_of(column)], pa.large_string())


BLOCK = 1 << 23
"""Bytes of texts encoded at once, about."""


def encode(docs: DataFrame, pieces: DataFrame, objectives: tuple[str, ...] = ("viterbi",)) -> DataFrame:
    """(doc_id, ids and a column of each further objective) for each row of ``docs``
    (doc_id, text; others are ignored).

    A null or empty text has no ids; rows that repeat a doc_id give a row each; an empty
    table gives none. A word is encoded once in a batch, however often it comes.
    """
    common.small_batches(docs.sparkSession, 2000)
    shared = _shared(pieces, objectives)

    def code(doc_id, texts):
        words, n = marked_words(texts)
        coded = words.dictionary_encode()
        place, docs_at = coded.indices.to_numpy(), np.append(0, np.cumsum(n))
        found = shared.value.encode(coded.dictionary, objectives)
        for x, y in _lots(n, LOT):
            own, columns = place[docs_at[x] : docs_at[y]], []
            for ids, bounds in found:
                size = bounds[own + 1] - bounds[own]
                at = np.append(0, np.cumsum(size))
                columns.append(_lists(ids[np.arange(at[-1]) + np.repeat(bounds[own] - at[:-1], size)], at[docs_at[x : y + 1] - docs_at[x]]))
            yield pa.RecordBatch.from_arrays([doc_id.slice(x, y - x), *columns], ["doc_id", "ids", *objectives[1:]])

    def search(batches):
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for x, y in _lots(size, BLOCK):
                yield from code(b.column(0).slice(x, y - x), _texts(b.column(1).slice(x, y - x)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, _schema("doc_id", objectives))


def decode(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): pieces joined, byte pieces as UTF-8, marks as
    blanks, without the first; control pieces vanish. Null ids give an empty text."""
    table = pieces.select("id", "kind", F.when(F.col("kind") == "byte", F.substring("piece", 4, 2)).when(F.col("kind") == "normal", F.hex(F.encode("piece", "UTF-8"))).otherwise("").alias("code"))
    rows = encoded.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "ids")
    rows = common.stored(rows, "ids")
    parts = rows.select("_row", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(table), "id")
    text = parts.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("p"))
    text = text.select("_row", F.decode(F.unhex(F.array_join(F.transform("p", lambda p: p["code"]), "")), "UTF-8").alias("text"))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), MARK, " ")
    return rows.select("_row", "doc_id").join(text, "_row", "left").select("doc_id", F.regexp_replace(plain, "^ ", "").alias("text"))
