"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Texts are lower-cased, look-alike letters of other scripts and digits or signs that stand
for letters are folded, and everything but letters becomes one blank. The lexicon holds
whole words and word beginnings with the log-odds of their documents' labels; matches
inside exception phrases do not count. The weights of a text's matched words, their
density by length and the greatest one give the score by a logistic function.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Look-alike letters (Cyrillic and Greek) and their Latin forms.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнαορτυνικεη", "aeopcyxijsdhkmtbhaoptuvikeh"))
# Digits and signs that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
# Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "pond scum", "sore loser", "idiot proof")

_LATIN = str.maketrans(HOMOGLYPHS | {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)})
_INSIDE = re.compile(r"(?<=[^\W\d_])[01345780@$](?=[^\W_])|(?<![^\W_])[01345780@$](?=[^\W\d_]{2})")
_OTHER = re.compile(r"[\W\d_]+")
_LOOKALIKE = re.compile("[" + "".join(HOMOGLYPHS) + "！-～]")
_DIGIT = re.compile(r"[^\W\d_][01345780@$]+[^\W\d_]|[01345780@$][^\W\d_]{2}")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[@$](?=[^\W_]))*|[@$](?:[^\W_]|[@$](?=[^\W_]))+")


def _spell(match: re.Match) -> str:
    word = match.group()
    letters = sum(c.isalpha() for c in word)
    return "".join(SUBSTITUTES.get(c, c) for c in word) if 2 * letters > len(word) and letters < len(word) else word


def fold(text: str) -> str:
    """Lower case, folded, with words between single blanks, also at both ends. Digits and
    signs are letters only in words made mostly of letters."""
    text = text.lower()
    if not text.isascii() and _LOOKALIKE.search(text):
        # words of another script stay: only letters among Latin ones are folded
        text = re.sub(r"\w*[a-zＡ-～]\w*", lambda m: m.group().translate(_LATIN), text).lower()
    if _DIGIT.search(text):
        text = _TOKEN.sub(_spell, text)
    return f" {_OTHER.sub(' ', text).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """``weights``: " word " (a whole word) or " begin" (a word's beginning) to weight;
    ``beta``: the logistic function's constant and factors."""

    weights: dict[str, float]
    beta: tuple[float, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for key, w in self.weights.items():
            a.add_word(key, (len(key), w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, None))
        a.make_automaton()
        return a


def features(text: str, automaton) -> tuple[float, float, float]:
    """(log of 1 + the weights' sum, their share of the words, the greatest weight); each
    word counts once, by its best match."""
    folded = fold(text)
    best: dict[int, float] = {}
    except_: list[tuple[int, int]] = []
    if len(automaton):
        for end, (n, w) in automaton.iter(folded):
            start = end - n + 1
            if w is None:
                except_.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
    for a, b in except_:
        best = {s: w for s, w in best.items() if not a <= s < b}
    total = sum(best.values())
    words = max(1, folded.count(" ") - 1)
    return math.log1p(total), min(1.0, total / words), max(best.values(), default=0.0)


def probability(f: np.ndarray, beta) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(beta[0] + f @ np.asarray(beta[1:]), -30, 30)))


def fit_logistic(f: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Newton steps for a ridge-penalised logistic function (the constant is free)."""
    x = np.column_stack([np.ones(len(f)), f])
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * f.shape[1]])
    for _ in range(30):
        p = probability(f, beta)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def train(docs: DataFrame, labels: DataFrame, rows: int = 30_000, least: int = 3, beginnings: int = 10, odds: float = 2.0, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    At most about ``rows`` labelled texts, chosen by a hash of the text, are used for both
    the weights and the logistic function; null labels and ids are left out. The choice is
    made from hashes, so only chosen texts are shuffled. Entries are whole words and
    beginnings of 3 to ``beginnings`` letters; one needs ``least`` toxic documents and
    log-odds of ``odds`` beyond the base rate. All such entries are kept: there are no
    more than the chosen texts give, whatever the input. No rows: an empty lexicon.
    """
    common.small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    labels = labels.filter("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    place = F.pmod(F.xxhash64("h"), F.lit(1 << 30))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    # the same text twice says nothing new, and copies would look like evidence
    known = common.checkpoint(texts.select("doc_id", "h").join(labels, "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic")))
    total = known.count()
    part = min(1 << 30, int((1 << 30) * rows / max(1, total)))
    chosen = texts.filter(place < part).join(labels.select("doc_id"), "doc_id", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    pool = common.stored(chosen.join(known.filter(place < part), "h"), "labelled")
    n, toxic = pool.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == n:
        base = (toxic + 0.5) / (n + 1)
        return Lexicon({}, (math.log(base / (1 - base)), 0.0, 0.0, 0.0), exceptions)

    def count(batches):
        """Of each word, the toxic and the other documents that hold it, a batch at a time."""
        for b in batches:
            bad, good = Counter(), Counter()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (bad if y else good).update(set(fold(text).split()))
            words = list(bad | good)
            yield pa.record_batch([pa.array(words, pa.string()), pa.array([bad[w] for w in words], pa.int64()), pa.array([good[w] for w in words], pa.int64())], ["word", "bad", "good"])

    words = pool.select("text", "toxic").mapInArrow(count, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    words = common.checkpoint(words)
    keys = F.concat(F.array(F.concat(F.lit(" "), "word", F.lit(" "))), F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.least(F.lit(beginnings), F.length("word") - 1))), lambda k: F.concat(F.lit(" "), F.substring(F.col("word"), F.lit(1), k))))
    counts = words.select(F.explode(keys).alias("key"), "bad", "good").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (toxic + 1.0)) - F.log((F.col("good") + 0.5) / (n - toxic + 1.0))
    # how sure: the log-odds less two standard errors
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    strong = counts.filter(F.col("bad") >= least).select("key", "bad", "good", weight.alias("w"), (weight - error).alias("sure")).filter(f"w >= {odds} and sure >= {odds / 2}")
    found = strong.toPandas()  # from the chosen texts alone
    # of beginnings with the same counts, the longest says it all
    kept: dict[str, tuple] = {}
    for key, bad, good, sure in found[["key", "bad", "good", "sure"]].itertuples(index=False):
        kept[key] = (bad, good, sure)
    weights = {k: float(v[2]) for k, v in kept.items() if not any(kept.get(k + c, (0, 0))[:2] == v[:2] for c in _next(k, kept))}
    lexicon = Lexicon(weights, (0.0, 0.0, 0.0, 0.0), exceptions)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches):
        a = shared.value.automaton()
        for b in batches:
            f = [features(t, a) for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([x[k] for x in f], pa.float64()) for k in range(3)] + [b.column(1).cast(pa.float64())], ["a", "b", "c", "y"])

    sample = pool.select("text", "toxic").mapInArrow(measure, "a double, b double, c double, y double").toPandas().to_numpy()
    return Lexicon(weights, fit_logistic(sample[:, :3], sample[:, 3]), exceptions)


def _next(key: str, kept: dict) -> set[str]:
    return {k[len(key)] for k in kept if len(k) == len(key) + 1 and k.startswith(key)}


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """All rows and columns of ``docs`` with score (0 to 1, by the text alone) and predicted.

    A null or empty text has no matches and takes the score of such texts; columns named
    score or predicted are replaced; an empty table gives none.
    """
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    columns = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches):
        lex = shared.value
        a = lex.automaton()
        for b in batches:
            texts = b.column(b.schema.get_field_index("_text")).to_pylist()
            f = np.array([features(t or "", a) for t in texts]).reshape(-1, 3)
            p = probability(f, lex.beta)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*columns, "score", "predicted"])

    schema = docs.select(columns).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*columns, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)
