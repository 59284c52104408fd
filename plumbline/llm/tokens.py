"""Encoding with public tokenizers, a task at a time, with repeated words encoded once."""

from __future__ import annotations

import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?<=\S)(?= \S)")
_MARKS = string.punctuation
_SIGNS = re.compile(r"[!-/:-@\[-`{-~]*")
_cached: dict[tuple[str, str], CachedEncoder] = {}


class CachedEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, equal to those of
    ``Tokenizer.encode(text, add_special_tokens=False)`` of the tokenizer as it is in its
    file: strings of its added tokens in a text become these tokens, and such texts are
    encoded as they are.

    Both tokenizers split a text before they merge, never across the cuts used here, so
    the ids of a text are those of its chunks, one after another, and a chunk that comes
    again is looked up. ``kind`` "word": white space is dropped, so any blank or line end
    cuts. ``kind`` "byte": a blank belongs to the word behind it, so only a single blank
    between two other characters cuts; a text with other blanks is encoded as it is.
    The store of chunks is emptied when it holds ``most`` of them.
    """

    def __init__(self, path: str, kind: str, most: int = 500_000, longest: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings of added tokens, and whether they are sought after the text is normalised
        self.added = sorted((t.content, t.normalized) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.kind, self.most, self.longest = kind, most, longest
        self.known: dict[str, bytes] = {}
        self.plain: set[str] = set()  # letters beyond ASCII that stay letters when normalised
        # pieces that end a word, or that begin with a blank
        pieces = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.edges = np.array([x.endswith("</w>") if kind == "word" else x.startswith("Ġ") for x in pieces])

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: set[str]) -> None:
        new = [x for x in chunks if x not in self.known and len(x) <= self.longest]
        # both tokenizers part letters from the marks behind them
        bases = {x: self._base(word) for x in new if (word := x.rstrip(_MARKS)) != x and self._letters(word)}
        if bases:
            self._add([x for x in {*bases.values()} if x not in self.known])
            tails = [*{x[len(base) :] for x, base in bases.items()}]
            signs = dict(zip(tails, self._ids(tails)))
            self.known.update((x, self.known[base] + signs[x[len(base) :]]) for x, base in bases.items() if self.known.get(base))
            new = [x for x in new if x not in bases]
        lower = {x: base for x in new if (base := self._base(x)) != x}
        self._add([x for x in {*new, *lower.values()} if x not in self.known and x not in lower])
        self.known.update((x, self.known[base]) for x, base in lower.items())

    def _letters(self, word: str) -> bool:
        """Whether a word is letters only, also as the tokenizer normalises it: a letter that
        becomes a letter and a mark is parted from what follows in other places."""
        if not word.isalpha():
            return False
        if word.isascii() or self.plain.issuperset(word):
            return True
        rule = self.tokenizer.normalizer
        self.plain.update(x for x in {*word} - self.plain if rule is None or rule.normalize_str(x).isalpha())
        return self.plain.issuperset(word)

    def _base(self, word: str) -> str:
        """What has the same ids, where the tokenizer ignores case."""
        low = word.lower() if self.kind == "word" and word.isascii() else word
        return word if low != word and any(content in low for content, _ in self.added) else low

    def _add(self, new: list[str]) -> None:
        letters = [x for x in new if self._letters(x)]
        if letters:
            # words of letters stand apart in one text: an end (or a blank in front) shows where
            ids = np.frombuffer(self._ids([" " + " ".join(letters)])[0], "<u4")
            edge = np.flatnonzero(self.edges[ids])
            if len(edge) == len(letters):
                cuts = [0, *(edge + 1).tolist()] if self.kind == "word" else [*edge.tolist(), len(ids)]
                raw = ids.tobytes()
                self.known.update((w, raw[4 * x : 4 * y]) for w, x, y in zip(letters, cuts, cuts[1:]))
                parted = set(letters)
                new = [x for x in new if x not in parted]
        if self.kind == "word":
            self.known.update(zip(new, self._ids(new)))
            return
        plain = [x for x in new if x and not x[0].isspace() and not x[-1].isspace()]
        self.known.update(dict.fromkeys(new, b""))  # not to be cut here
        self.known.update(zip(plain, self._ids([" " + x for x in plain])))

    def encode(self, texts: list[str] | pa.Array, block: int = 1 << 23) -> list[bytes]:
        """Ids of each text (null: empty); works through about ``block`` bytes at a time."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        column = pc.fill_null(column, "")
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        out: list[bytes] = []
        at = 0
        while at < len(column):
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + block, "right")))
            out += self._encode(column.slice(at, stop - at))
            at = stop
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        word = self.kind == "word"
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " ") if word else texts, " ")
        cuts = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        distinct, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = list(map(self.known.get, distinct))
        if None in found:
            missing = {w for w, x in zip(distinct, found) if x is None}
            if len(self.known) + len(missing) > self.most:
                # what this batch holds stays: common words among it
                self.known = {w: x for w, x in zip(distinct, found) if x is not None}
            self._learn(missing)
            # what is too long to keep is encoded each time
            found = [x if x is not None else self.known[w] if w in self.known else self._ids([w])[0] if word else b"" for x, w in zip(found, distinct)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        n = sizes[place]
        if not word:
            # the first word of a text has no blank before it, and needs no one behind a blank
            heads = [distinct[k] for k in place[cuts[:-1]].tolist()]
            firsts = self._ids(heads)
            bad = n == 0
            n[cuts[:-1]] = 0
            bad[cuts[:-1]] = [bool(k > 1 and (not h or h[-1].isspace())) for h, k in zip(heads, np.diff(cuts).tolist())]
            again = np.add.reduceat(bad, cuts[:-1]) > 0
        begin = np.concatenate([[0], np.cumsum(n)])
        special = np.zeros(len(texts), dtype=bool)
        bound, raw = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :], texts.buffers()[2]
        raw = raw.slice(bound[0], bound[len(texts)] - bound[0]).to_pybytes() if raw else b""
        for content, loose in self.added:
            # signs have no case: a text without those in front cannot hold the token
            if (_SIGNS.match(content)[0] if loose else content).encode() in raw:
                special |= pc.match_substring(texts, content, ignore_case=loose).to_numpy(zero_copy_only=False)
        # token t of word w stands at the word's place in flat plus t
        ids = flat[np.arange(begin[-1]) + np.repeat((np.cumsum(sizes) - sizes)[place] - begin[:-1], n)]
        ends = begin[cuts].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        if not word:
            out = [first + x for first, x in zip(firsts, out)]
            for i in np.flatnonzero(again).tolist():
                out[i] = b"".join(self._ids(_CUT.split(texts[i].as_py())))
        for i in np.flatnonzero(special).tolist():
            out[i] = self._ids([texts[i].as_py()])[0]
        return out


def encoder(path: str, kind: str) -> CachedEncoder:
    """The encoder of this Python worker."""
    if (path, kind) not in _cached:
        _cached[path, kind] = CachedEncoder(path, kind)
    return _cached[path, kind]
