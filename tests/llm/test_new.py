"""SuperMinHash, filter audit and periodic runs against brute force."""

import collections
import hashlib
import itertools
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, filter_audit, minhash, periodic, queries, shingle_join, substring, superminhash
from tests.llm.test_llm import SCHEMA, WORDS, joined, rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def thue_morse(k):
    s = "a"
    for _ in range(k):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


# ---- word hashes ----


def test_word_hashes_keep_built_words_apart(spark):
    a, b = thue_morse(10)  # 1024 letters whose polynomial hashes agree modulo 2**64
    h = [common.word_hashes(t.encode(), *common.word_spans(t.encode())) for t in (f"{a} x {b}", f" {b}\n{a}")]
    assert h[0][0] == h[1][1] != h[0][2] == h[1][0]
    words = [bytes(x) for n in (1, 2, 3) for x in itertools.product(b"ab\x00\x01", repeat=n)] + [b"a" * n for n in range(1, 200)]
    h = common.word_hashes(b" ".join(words), *common.word_spans(b" ".join(words)))
    assert len(set(h.tolist())) == len(set(words))
    long = [a[:n] + b[n:] for n in range(0, 65)]
    assert len({int(common.word_hashes(x.encode(), *common.word_spans(x.encode()))[0]) for x in long}) == len(set(long))
    left = [f"l{i}" for i in range(20)]
    texts = [" ".join([*left, w, *(f"r{i}" for i in range(20))]) for w in (a, b)]
    two = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in substring.remove_repeats(two).collect()] == [0, 0]
    six = [" ".join([w + x for x in "uvwxyz"]) for w in (a, b)]
    assert not (minhash.signature(minhash.shingles(six[0].encode())) == minhash.signature(minhash.shingles(six[1].encode()))).all()
    near = shingle_join.near_duplicates(spark.createDataFrame(list(enumerate(six)), "doc_id long, text string")).collect()
    assert len({r.component_id for r in near}) == 2


# ---- 11 ----


def one_by_one(hashes, places):
    """A signature as the paper words it: a shuffle of the places for each element."""
    best = [None] * places
    for x in hashes:
        p = list(range(places))
        for j in range(places):
            u = int(common.mix(np.array([x], np.uint64) + np.array([j + 1], np.uint64) * common._R)[0])
            k = j + ((u & 0xFFFFFFFF) * (places - j) >> 32)
            p[j], p[k] = p[k], p[j]
            v = j << 32 | u >> 32
            best[p[j]] = v if best[p[j]] is None else min(v, best[p[j]])
    return best


def test_superminhash_signatures():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 2, 7, 0, 60, 400)]
    got = superminhash.signatures(np.concatenate(sets), np.array([len(s) for s in sets]), 40)
    for signed, s in zip(got, sets):
        assert signed.tolist() == one_by_one(s.tolist(), 40) if len(s) else (signed == superminhash._EMPTY).all()
    assert superminhash.signatures(np.zeros(0, np.uint64), np.zeros(0, np.int64)).shape == (0, 240)
    errors = []
    for _ in range(300):  # sets of 50 with 35 in common: a similarity of 35 / 65
        u = rng.integers(0, 1 << 63, 65, dtype=np.uint64)
        errors.append(superminhash.likeness(*superminhash.signatures(np.concatenate([u[:50], u[15:]]), np.array([50, 50]))) - 35 / 65)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.9 * math.sqrt(35 / 65 * 30 / 65 / 240)


def shingle_text_set(text, k):
    w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def expected_groups(given, k, num, den):
    sets = [shingle_text_set(t, k) for _, t in given]
    edges = [(a, b) for a in range(len(given)) for b in range(a) if given[a][0] is not None and given[b][0] is not None and (given[a][0] == given[b][0] or sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]))]
    group = joined(edges, len(given))
    low = collections.defaultdict(list)
    for (i, _), g in zip(given, group):
        if i is not None:
            low[g].append(i)
    return collections.Counter((i, len(s), min(low[g]) if i is not None else None, i is None or i == min(low[g])) for (i, _), s, g in zip(given, sets, group))


@pytest.mark.parametrize("k,num,den", [(5, 85, 100), (2, 1, 2)])
def test_superminhash_groups(spark, docs, nothing, k, num, den):
    got = superminhash.near_duplicates(docs, k, Fraction(num, den), *((40, 6) if num == 85 else (60, 2))).collect()
    assert collections.Counter(map(tuple, got)) == expected_groups([(r[0], r[1]) for r in rows()], k, num, den)
    assert superminhash.near_duplicates(nothing).count() == 0


def test_superminhash_links_at_the_edge(spark):
    rng, given = np.random.default_rng(4), []
    for i in range(300):  # pairs of n shingles each that share n - k: just above and just below 0.85
        n = int(rng.integers(14, 150))
        k = int((n * 3 // 37)) + i % 2
        w = [f"w{x}" for x in rng.integers(0, 10**9, n + 4 + k)]
        assert (100 * (n - k) >= 85 * (n + k)) == (i % 2 == 0)
        given += [(2 * i, " ".join(w[: n + 4])), (2 * i + 1, " ".join(w[k:]))]
    out = superminhash.near_duplicates(spark.createDataFrame(given, "doc_id long, text string")).collect()
    kept = {r.doc_id for r in out if r.kept}
    assert kept == {i for i, _ in given} - {2 * i + 1 for i in range(0, 300, 2)}


def test_superminhash_large_group(spark):
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(1500):  # each differs from the base in one place: all are linked
        w = list(base)
        w[int(rng.integers(0, 200))] = f"x{i}"
        texts.append((i + 5, " ".join(w)))
    out = superminhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.component_id for r in out} == {5} and sum(r.kept for r in out) == 1


def test_op11_query(spark, tmp_path):
    given = [(r[0], r[1]) for r in rows()]
    spark.createDataFrame(given, "doc_id long, text string").withColumn("fp", F.lit("f")).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_superminhash(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert collections.Counter(map(tuple, out.collect())) == expected_groups(given, 5, 85, 100)


def test_links_known_before(spark):
    texts = [(i, i, " ".join([*(f"w{x}" for x in range(60)), f"z{i}"])) for i in range(3)]
    sets = [shingle_join.shingle_set(t.encode(), 5) for _, _, t in texts]
    table = [(i, i, i, len(s), bytearray(shingle_join.shingle_map(s).tobytes()), [1]) for i, s in enumerate(sets)]
    classes = spark.createDataFrame(table, "id long, doc_id long, tag long, size long, map binary, keys array<long>")
    whole = spark.createDataFrame(texts, "doc_id long, tag long, text string")
    pairs = lambda *first: sorted(map(tuple, shingle_join.links(classes, whole, 5, Fraction(4, 5), 512, *first).collect()))
    assert pairs() == [(0, 1), (0, 2), (1, 2)]
    assert pairs(spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")) == [(0, 1), (1, 2)]


def test_forest(spark):
    edges = [(1, 2), (2, 3), (3, 1), (7, 9), (9, 8), (5, 5), (4, 1)]
    out = superminhash.forest(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()
    assert sorted((r.a, r.b) for r in out) == [(2, 1), (3, 1), (4, 1), (8, 7), (9, 7)]


# ---- 12 ----


def brute_audit(given, labels):
    first, flags = {}, collections.defaultdict(lambda: [0, 0])
    for i, t, _ in given:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        flags[i] = [max(flags[i][0], int(q == 1)), max(flags[i][1], int(x == 1))]
    docs = collections.defaultdict(list)
    for i, t, lang in given:
        t = t or ""
        w = re.findall(WORDS, t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs[lang or ""].append(({f for f, x in fails.items() if x}, *(flags[i] if i is not None else [0, 0])))
    out = []
    for part, found in docs.items():
        every = {}
        for order in itertools.permutations("ABCDE"):
            left = list(found)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                every["".join(order), step] = [len(left), len(gone), sum(f in d[0] for d in found) - len(gone), sum(d[0] == {f} for d in found), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        total = collections.Counter()
        for (o, step), v in every.items():
            total[o[step - 1]] += v[1]
        out += [(part, o, step, *v, total[o[step - 1]]) for (o, step), v in every.items()]
    return sorted(out)


def audit_rows(spark, given, labels):
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string").withColumns({"mask": F.lit("m"), "n": F.lit(1), "digest": F.lit("d"), "part": F.lit("p"), "good": F.lit(3)})
    flags = spark.createDataFrame(labels, "doc_id long, good int, toxic int")
    return sorted(map(tuple, filter_audit.audit(filter_audit.masks(docs, filter_audit.text_failures(), "E", "lang", flags), list("ABCDE")).collect()))


def test_filter_audit(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcXY$#é日"), rng.integers(1, 5), p=[0.2, 0.2, 0.2, 0.07, 0.07, 0.01, 0.01, 0.12, 0.12]))
    texts = [" ".join(word() for _ in range(rng.integers(60, 160))) for _ in range(80)]
    texts += texts[:25] + [None, "", "", "ABC", " \n", "x " * 30_000]
    given = [(int(rng.integers(0, 90)) if i % 9 else i, t, [None, "", "en", "de"][i % 4]) for i, t in enumerate(texts)]
    given += [(None, texts[0], "en"), (None, texts[0], "en"), given[3], given[3]]
    labels = [(int(rng.integers(0, 90)), [None, 0, 1][i % 3], int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1)]
    got = audit_rows(spark, given, labels)
    assert got == brute_audit(given, labels) and len(got) == 3 * 600
    assert audit_rows(spark, [], labels) == []


def test_filter_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "x", 50), (3, "b", None, 500)], "doc_id long, text string, lang string, v int")
    counted = filter_audit.masks(docs, {"low": F.col("v") < 10, "high": F.col("v") > 100})
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in filter_audit.audit(counted, ["L", "H"]).collect()}
    assert out[("x", "LH", 1)] == (1, 1, 2) and out[("", "LH", 2)] == (0, 1, 2) and len(out) == 8
    with pytest.raises(ValueError):
        filter_audit.audit(counted, [])


# ---- 13 ----


def brute_runs(w, least):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, 2 * q) and not any(w[i : i + size - d] == w[i + d : i + size] for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs():
    rng, fib = np.random.default_rng(6), ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    for t in range(400):
        n = int(rng.integers(0, 90))
        w = [rng.integers(0, 2, n).tolist(), rng.integers(0, 3, n).tolist(), [ord(c) for c in fib[-1][t % 50 : t % 50 + n]], (rng.integers(0, 9, 5).tolist() + rng.integers(0, 50, int(rng.integers(1, 12))).tolist() * 4 + [1])][t % 4]
        for least in (12, 5, 2):
            assert periodic.runs(np.array(w, np.int64), least) == brute_runs(w, least)


def test_runs_of_long_texts():
    assert periodic.runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    tail = np.concatenate([np.arange(30_000), np.tile(np.arange(777), 40)])
    assert periodic.runs(tail) == [(30_000, 777 * 40, 777)]


def expected_op13(doc_id, text):
    w = re.findall(WORDS, text or "")
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w, 12)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{x},{q}\n" for s, x, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op13(spark, docs, nothing, tmp_path):
    rng = np.random.default_rng(12)
    given = [(r[0], r[1]) for r in rows() if len(r[1] or "") < 2000] + [(None, "a b " * 12), (None, None)]
    given += [(1000 + i, " ".join(rng.choice(["x", "y", "z é"], rng.integers(1, 70)))) for i in range(150)]
    spark.createDataFrame(given, "doc_id long, text string").withColumns({"runs": F.lit(1), "words": F.lit("w"), "g": F.lit(0)}).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    want = collections.Counter(expected_op13(*x) for x in given)
    assert collections.Counter(map(tuple, out)) == want and sum(x[1] > 1 for x in want) > 20
    assert periodic.find_runs(nothing).count() == 0
    kept = periodic.find_runs(docs).collect()
    assert len(kept) == len(rows()) and periodic.find_runs(docs).columns == [*docs.columns, "n_words", "runs", "collapsed"]
