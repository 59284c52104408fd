"""The training-data operators against brute force, with nulls, repeats, ties and nothing."""

import collections
import hashlib
import io
import math
import re
import string
import time
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import common, components, hilbert, maxscore, minhash, packing, piece_lattice, queries, shingle_join, simhash, substring, token_store, tokens, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, size long, marks string, fp string"
WORDS = "[^\\x20\\x09-\\x0D]+"


def rows(n=60, seed=1):
    """Documents with nulls, repeats, near copies, shared passages and a very long text."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé日"), rng.integers(1, 9)))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(word() for _ in range(rng.integers(1, 90))) for _ in range(n)]
    texts[3] = texts[4] = passage + " " + texts[3]
    texts[5] = texts[6] + " " + passage
    texts[7] = "na " * 200
    texts[8] = " ".join(word() for _ in range(8000))
    texts[9] = texts[8].replace("a", "b", 1)
    texts += [None, "", " \n\t ", "one", "A.  b\n\nC\r\nd ", texts[10], texts[11].upper()]
    out = [(i * 3, t, None if i % 5 == 0 else "en", f"s{i % 3}" if i % 4 else None, None, 1.0, "k", 5, "m", "f") for i, t in enumerate(texts)]
    return out + [out[2], out[2], (None, "no id", *out[0][2:]), (out[12][0], "other text", *out[0][2:]), (900, "the <|endoftext|> of it", *out[0][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


# ---- 1 ----


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_cached_encoder(name, kind):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    texts = [r[1] or "" for r in rows()] + ["", " a", "a ", "a  b", "x\n y", " z w", "a\x1c b", "<|endoftext|> x", "end <|endoftext|> here", "<|EndOfText|>", "a<|startoftext|>b  c <|endoftext|><|endoftext|>", "It's we'll. THE the, The!", "x" * 5000, "é ́x", "İstanbul, ﬁn."]
    texts += ["ANKARA BAŞKENTİ. BAŞKENTİ, İ! İ ǰ. ŉ? ΐ. İİ.x", "ΰ. ẖ, ŀ! ẚ? Ⅸ. ª! ﷺ, ㎏."] + [f"{chr(c)}. a{chr(c)}, {chr(c)}b! {chr(c)}" for c in range(0xC0, 0x2000, 3)]
    for most in (10, 10**6):
        got = tokens.CachedEncoder(public_tokenizers.path(name), kind, most).encode(texts * 2, block=500)
        assert got == [np.array(e.ids, dtype="<u4").tobytes() for e in t.encode_batch(texts * 2, add_special_tokens=False)]


def test_rank_coding():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = rng.choice([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], n).astype(np.uint32)
        control, data = token_store.encode_ranks(ranks)
        assert len(control) == -(-n // 4)
        assert (token_store.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()
    with pytest.raises(ValueError):
        next(token_store.read_blocks(io.BytesIO(b"x" * 20), np.zeros(1)))


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_asks_for_ids_only(name, kind):
    made = tokens.CachedEncoder(public_tokenizers.path(name), kind)

    class Fast:  # without the slower call, which also finds offsets and texts
        def __getattr__(self, what, real=made.tokenizer):
            assert what != "encode"
            return getattr(real, what)

    want = made.tokenizer.encode("some words stand here", add_special_tokens=False).ids
    made.tokenizer = Fast()
    assert np.frombuffer(made.encode(["some words stand here"])[0], "<u4").tolist() == want


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_parts_marks_from_words(name, kind):
    """A word with any marks behind it is encoded once, and its marks by themselves."""
    made = tokens.CachedEncoder(public_tokenizers.path(name), kind)
    real, asked = made.tokenizer, []

    class Counted:
        def __getattr__(self, what):
            return getattr(real, what)

        def encode_batch_fast(self, texts, **options):
            asked.extend(w for t in texts for w in t.split())
            return real.encode_batch_fast(texts, **options)

    made.tokenizer = Counted()
    tails = ["###", "$$$,", ".***", "!!", "'", "'.", "<|", "_", ")\"", "...", "%%%"]
    words = ["blümchen", "zebra", "ŉx", "ΐo", "ड़a", "word"]
    texts = ["x " + " ".join(w + t for w in words for t in tails)] + [f"x {w}{c}{d} {c}{w}{d}'s" for w in words for c in string.punctuation for d in ".'#"]
    assert made.encode(texts) == [np.array(real.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert asked.count("zebra") == 1 and not any("zebra" + t in asked for t in tails)


def test_token_files(spark, docs, nothing):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    path = common.new_path(spark, "t")
    got = token_store.read_token_files(spark, path, token_store.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), block_ids=100)).collect()
    want = collections.Counter((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert token_store.read_token_files(spark, path, token_store.write_token_files(nothing, common.new_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json"))).count() == 0


# ---- 2 ----


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_top_k(spark, k):
    rng = np.random.default_rng(k)
    vectors = [(i, rng.normal(0, 0.2, 16).round(2).tolist()) for i in range(300)]
    vectors += [(400 + i, vectors[7][1]) for i in range(30)] + [(500, [0.0] * 16), (501, None), (502, [float("nan")] * 16), (503, [None] * 16), (None, [1.0] * 16), (520, [float("inf")] + [0.0] * 15), (540, [-0.01] * 16)]
    df = maxscore.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    got = maxscore.top_k(df, df.filter("vec_id % 20 = 0"), k, shard_rows=64, query_rows=5).collect()
    v = {r.vec_id: np.array(r.v) for r in df.collect()}
    assert set(v) == {i for i, x in vectors if i not in (501, 502, 503, None, 520)}
    want = []
    for q in v:
        if q % 20 == 0:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:k]
            want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert maxscore.top_k(df.limit(0), df.limit(0), k).count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(3)
    sizes = [1.0, 1e3, 3e7, 1e12, 1e17, 3e38]
    vectors = [(i, (rng.normal(0, 1, 4) * rng.choice(sizes, 4)).tolist()) for i in range(200)] + [(300, [3e38] * 4), (320, [-3e38] * 4), (340, [0.0] * 4)]
    df = maxscore.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    low, high = -(1 << 63), (1 << 63) - 1
    v = {i: [min(max(math.floor(64 * x), low), high) for x in e] for i, e in vectors}
    assert {r.vec_id: list(r.v) for r in df.collect()} == v
    want = []
    for q in v:
        if q % 20 == 0:
            best = sorted((-min(max(sum(x * y for x, y in zip(v[q], v[c])), low), high), c) for c in v if c != q)[:9]
            want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    got = maxscore.top_k(df, df.filter("vec_id % 20 = 0"), 9, shard_rows=64, query_rows=5).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_searches_queries_together():
    """Many queries against a shard take no more than three plain products of whole numbers;
    one after another they took over five."""
    rng = np.random.default_rng(8)
    v = np.floor(rng.normal(0, 8, (8192, 64))).astype(np.int64)
    v[rng.random(v.shape) < np.linspace(0, 0.99, 64)] = 0
    v[100] = v[20]
    ids = rng.permutation(len(v))
    t = time.process_time()
    row, found, scores = maxscore.Shard(ids, v).search(v[::10], ids[::10], 20)
    took = time.process_time() - t
    t = time.process_time()
    plain = v[::10] @ v.T
    assert took < 3 * (time.process_time() - t)
    for k, (i, s) in enumerate(zip(ids[::10], plain)):
        best = [x for x in np.lexsort((ids, -s)) if ids[x] != i][:20]
        assert found[row == k].tolist() == ids[best].tolist() and scores[row == k].tolist() == s[best].tolist()


# ---- 3 ----


def brute_fit(lengths, caps, weights, rule):
    bins = []
    for n in lengths:
        need = (n, 1, n * n)
        best = None
        for k, b in enumerate(bins):
            if all(x >= y for x, y in zip(b, need)):
                part = [w / c**2 * ((x - y) ** 2 if rule == "norm" else -x * y) for w, c, x, y in zip(weights, caps, b, need)]
                if best is None or part[0] + part[1] + part[2] < best[0] - 1e-12:
                    best = (part[0] + part[1] + part[2], k)
        if best is None:
            best = (0, len(bins))
            bins.append(list(caps))
        bins[best[1]] = [x - y for x, y in zip(bins[best[1]], need)]
        yield best[1]


@pytest.mark.parametrize("documents,cost", [(1024, 1024**2), (3, 1024**2), (1024, 400_000)])
def test_best_fit_constraints(documents, cost):
    n = np.sort(np.random.default_rng(4).integers(1, 600, 300))[::-1].copy()
    for rule in ("norm", "dot"):
        for weights in ((1.0, 0.0, 0.0), (1.0, 1.0, 1.0), (1.0, 0.2, 0.5)):
            bins = packing.best_fit(n, 1024, documents, cost, weights, rule)
            for b in set(bins.tolist()):
                own = n[bins == b]
                assert own.sum() <= 1024 and len(own) <= documents and (own**2).sum() <= cost
            assert bins.tolist() == list(brute_fit(n.tolist(), (1024, documents, cost), weights, rule))


def check_packing(got, texts, capacity=1024):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for doc_id, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, n in enumerate(packing.cut_lengths(len(ids), capacity)):
            want[doc_id, k, at, n, crc(ids[at : at + n])] += 1
            at += n
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark, docs, nothing):
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    for group_rows in (10, 20_000):
        used = check_packing(packing.pack(cut, group_rows=group_rows).collect(), [r[:2] for r in rows()])
    empty = packing.pieces(spark.range(1024).selectExpr("id as doc_id", "cast(null as string) as text"), public_tokenizers.path("byte_bpe_50k.json"))
    assert check_packing(packing.pack(empty).collect(), [(i, None) for i in range(1024)]) == 1
    for limits in ({"documents": 3}, {"cost": 400_000}):
        few = packing.pack(cut.filter("length < 600"), **limits).collect()
        by = collections.defaultdict(list)
        for r in few:
            by[r.sequence_id].append(r.length)
        assert len(few) == cut.filter("length < 600").count()
        assert all(sum(v) <= 1024 and len(v) <= limits.get("documents", 1024) and sum(x * x for x in v) <= limits.get("cost", 1024**2) for v in by.values())
        assert max(map(len, by.values())) == 3 or "cost" in limits
    total = sum(r.length for r in cut.collect())
    assert used <= -(-total // 1024) + 1
    assert packing.pack(packing.pieces(nothing, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        packing.pack(spark.createDataFrame([(1, 0, 2000)], "doc_id long, piece int, length long")).collect()


# ---- 4 ----


def brute_simhash(text, k=4):
    w = [x.decode() for x in re.findall(WORDS.encode(), (text or "").encode().lower())]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(n, linked):
    label = list(range(n))
    for a, b in linked:
        x, y = label[a], label[b]
        if x != y:
            label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_simhash(spark, docs, nothing):
    data = rows()
    got = simhash.near_duplicates(docs, words=4, radius=4).collect()
    fps = [brute_simhash(r[1]) for r in data]
    assert collections.Counter((r.doc_id, int.from_bytes(r.fp, "big")) for r in got) == collections.Counter((r[0], f) for r, f in zip(data, fps))
    keep = [i for i, r in enumerate(data) if r[0] is not None]
    links = [(a, b) for a in keep for b in keep if a < b and (data[a][0] == data[b][0] or (fps[a] ^ fps[b]).bit_count() <= 4)]
    label = reach(len(data), links)
    want = {}
    for i in keep:
        want[data[i][0]] = min(data[j][0] for j in keep if label[j] == label[i])
    assert {r.doc_id: r.component_id for r in got} == want | {None: None}
    assert simhash.near_duplicates(nothing, words=4).count() == 0


def test_position_sets():
    import itertools

    sets = simhash.guaranteed_sets(8, 4, 3)
    assert len(sets) == 20
    assert all(any(set(s) <= set(four) for s in sets) for four in itertools.combinations(range(8), 4))
    assert len(simhash.seeded_sets(32, 3, 50)) == 50


def test_bucket_blocks(spark):
    """A bucket cut into blocks connects what all pairs connect."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = list({int(base[i % 6]) ^ (1 << int(rng.integers(0, 12))) ^ (1 << int(rng.integers(0, 12))) for i in range(400)})
    df = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in enumerate(fps)], "rep long, fp binary")
    sets = simhash.guaranteed_sets(8, 4, 3)
    want = reach(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    for block in (7, 2048):
        e = [(r.a, r.b) for r in simhash.links(df, 4, sets, 4, block).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in e)
        assert reach(len(fps), e) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(300)] + [(5, None), (7, 7)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 5 ----


def test_fingerprints(spark, docs, nothing):
    data = [r for r in rows() if r[0] is not None]
    data = sorted({(r[0], r[1] or "") for r in data}, key=lambda r: (-r[0], r[1]))
    got = minhash.fingerprint_edits(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert len(got) == len(data)
    for i, (doc_id, text) in enumerate(data):
        after = data[(i + 1) % len(data)][1]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        r = by[doc_id, n]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (minhash.signature(minhash.shingles(t.encode())) for t in (text, edited, after))
        assert r.fingerprint == a.astype(">u2").tobytes().hex() and r.edited_fingerprint == b.astype(">u2").tobytes().hex()
        assert (r.near_edited, r.near_next) == (minhash.likeness(a, b), minhash.likeness(a, c))
    assert minhash.fingerprint_edits(docs).count() == len(rows())
    one = minhash.fingerprint_edits(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert minhash.fingerprint_edits(nothing).count() == 0


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.9):
        common_, own = rng.integers(0, 1 << 63, int(2000 * share), dtype=np.uint64), int(1000 * (1 - share))
        a, b = (np.concatenate([common_, rng.integers(0, 1 << 63, own, dtype=np.uint64)]) for _ in range(2))
        j = len(common_) / (len(common_) + 2 * own)
        assert abs(minhash.likeness(minhash.signature(a), minhash.signature(b)) - j) < 0.15


def test_minhash_near_duplicates(spark, nothing):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{rng.integers(0, 5000)}" for _ in range(150)) for _ in range(20)]
    texts = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        w = t.split()
        w[50] = "changed"
        texts += [(100 + i, " ".join(w)), (200 + i, t)]
    texts += [(None, base[0]), (300, None), (301, ""), (300, None)]
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), block=2).collect()
    sets = {i: set(minhash.shingles((t or "").encode()).tolist()) for i, t in texts if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a, x in enumerate(ids) for b, y in enumerate(ids) if a < b and (sets[x] == sets[y] or len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]))]
    label = reach(len(ids), links)
    assert {r.doc_id: r.component_id for r in got} == {x: ids[label[i]] for i, x in enumerate(ids)} | {None: None}
    assert minhash.near_duplicates(nothing).count() == 0


# ---- 6 ----


def test_fold():
    assert toxicity.fold("You ІDІОТ, 1d1ot! m0r0n\n$tupid") == " you idiot idiot moron stupid "
    assert toxicity.fold("") == "  " and toxicity.fold("2024 1985") == "  "
    assert "при" in toxicity.fold("при")


def test_matches():
    lex = toxicity.Lexicon({" clown ": 3.0, " scum": 2.0, " sc": 1.0}, (-3.0, 2.0, 0.0, 0.0))
    a = lex.automaton()
    weights = lambda t: round(np.expm1(toxicity.features(t, a)[0]), 6)
    assert weights("A clown") == 3 and weights("clowns") == 0 and weights("scumbag scent") == 3
    assert weights("a clown fish swims") == 0 and weights("clown and a clown fish") == 3
    assert toxicity.features("", toxicity.Lexicon({}, (0.0, 0.0, 0.0, 0.0), ()).automaton()) == (0.0, 0.0, 0.0)


def test_toxicity_learns(spark, docs, nothing):
    rng = np.random.default_rng(0)
    good = [f"w{i}" for i in range(300)]
    letters = [x.replace("w", "word").translate(str.maketrans("0123456789", "abcdefghij")) for x in good]
    data = []
    for i in range(300):
        words = list(rng.choice(letters, 40))
        toxic = int(i % 4 == 0)
        if toxic:
            words[5] = str(rng.choice(["moron", "badling" + str(rng.choice(["er", "es", "um"]))]))
        data.append((i, " ".join(words), toxic))
    data += [(1000, None, None), (1001, None, 0), (1001, None, 0), (1002, "", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    lex = toxicity.train(df.withColumn("h", F.lit("clash")), df)
    out = {r.doc_id: r for r in toxicity.score(df, lex).collect()}
    assert sum(out[i].predicted == y for i, _, y in data[:300]) >= 295
    assert 0 <= out[1000].score < 0.7 and out[1000].score == out[1001].score
    clash = toxicity.score(docs, lex)
    assert clash.columns.count("score") == 1 and clash.count() == len(rows()) and clash.filter("score = 1").count() == 0
    assert toxicity.score(nothing, lex).count() == 0
    none = toxicity.train(df, df.filter("toxic = 0"))
    assert none.weights == {} and toxicity.score(df, none).filter("predicted = 1").count() == 0
    assert toxicity.train(df.limit(0), df).weights == {} == toxicity.train(df, df.limit(0)).weights


def plain_score(text, lex):
    """The score by looking up every word and beginning, word by word."""
    words = toxicity.fold(text or "").split()
    free = [True] * len(words)
    for phrase in lex.exceptions:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                free[i : i + len(p)] = [False] * len(p)
    best = []
    for w, ok in zip(words, free):
        found = [lex.weights.get(f" {w} ", 0.0)] + [lex.weights.get(" " + w[:k], 0.0) for k in range(1, len(w) + 1)]
        best.append(max(found) if ok else 0.0)
    f = (np.log1p(sum(best)), min(1.0, sum(best) / max(1, len(words))), max(best, default=0.0))
    return 1 / (1 + np.exp(-np.clip(lex.beta[0] + np.dot(f, lex.beta[1:]), -30, 30)))


def test_toxicity_against_plain_lookup(spark, docs):
    d = "/root/testdata/sf0.01"
    lex = queries._learnt(spark, d)
    assert len(lex.weights) > 5
    table = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").union(docs.select("doc_id", "text"))
    extra = spark.createDataFrame([(10**6 + i, f"{x} and {y} clown fish {x} pond scum") for i, (x, y) in enumerate(zip(map(str.strip, lex.weights), toxicity.EXCEPTIONS * 50))], "doc_id long, text string")
    for r in toxicity.score(table.union(extra), lex).collect():
        want = plain_score(r.text, lex)
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.7)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = queries.op6_toxicity(spark, d).filter("held_out").join(labels, "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id)
    ranks, y = out["score"].rank().to_numpy(), out["toxic"].to_numpy()
    auc = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.9 and out[out.predicted == 1].toxic.mean() > 0.9 and out[out.toxic == 1].predicted.mean() > 0.7


# ---- 7 ----


@pytest.mark.parametrize("n,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve(spark, n, bits):
    cells = spark.range(1 << (n * bits)).select(*[F.expr(f"cast(shiftright(id, {bits * k}) & {(1 << bits) - 1} as int)").alias(f"c{k}") for k in range(n)])
    out = cells.withColumn("h", hilbert.hilbert_index([F.col(c) for c in cells.columns], bits)).orderBy("h").toPandas()
    assert out["h"].tolist() == list(range(1 << (n * bits)))
    assert (out.drop(columns="h").diff().abs().sum(axis=1)[1:] == 1).all()


def brute_curve(cells, bits):
    """Place of a cell on the curve, by turning it to the index bit by bit."""
    x, n = list(cells), len(cells)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        if x[-1] & q:
            t ^= q - 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out * 2 + ((v ^ t) >> b & 1)
    return out


def test_shards_by_brute_force(spark, docs):
    """Every row's place, from cells and hashes of each row alone."""
    text = F.coalesce("text", F.lit(""))
    data = [r.asDict() for r in docs.withColumn("size", F.octet_length(text) + 1).select("doc_id", text.alias("text"), "lang", "source", F.xxhash64(text).alias("h"), F.expr("coalesce(pmod(xxhash64(lang), 32), 0)").alias("a"), F.expr("coalesce(pmod(xxhash64(source), 32), 0)").alias("b")).collect()]
    first = {}
    for r in data:
        own = ((r["lang"] is not None, r["lang"] or ""), (r["source"] is not None, r["source"] or ""))
        first[r["text"]] = min(first.get(r["text"], (own, 0, 0)), (own, r["a"], r["b"])) if r["text"] in first else (own, r["a"], r["b"])
    want = []
    for r in data:
        size = len(r["text"].encode()) + 1
        _, a, b = first[r["text"]]
        cell = min(31, int(np.floor(2 * np.log2(size + 1))))
        want.append((brute_curve((a, b, cell), 5), r["h"], zlib.crc32(r["text"].encode()), -1 if r["doc_id"] is None else r["doc_id"], size))
    n, shards = len(want), 4
    out = collections.Counter()
    starts = [-(-k * n // shards) for k in range(shards)]
    for i, (curve, _, crc32, doc_id, size) in enumerate(sorted(want)):
        k = i * shards // n
        out[doc_id, size, crc32, curve, k, i - starts[k]] += 1
    got = hilbert.shard(docs, shards, "rows").select(F.coalesce("doc_id", F.lit(-1)), "size", "text_crc32", "curve", "shard", "slot").collect()
    assert collections.Counter(map(tuple, got)) == out
    places = collections.defaultdict(list)
    for i, x in enumerate(sorted(want)):
        places[x[1]].append(i)
    assert all(v[-1] - v[0] == len(v) - 1 for v in places.values())  # equal texts lie together


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, docs, nothing, law):
    data = rows()
    got = hilbert.shard(docs, 4, law).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data)
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        assert r.slot == len(by[r.shard])
        by[r.shard].append(r)
    curve = [r.curve for s in sorted(by) for r in by[s]]
    assert curve == sorted(curve)
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        big = max(r.size for r in got)
        sums = [sum(r.size for r in v) for v in by.values()]
        assert max(sums) <= sum(sums) / 4 + big
    assert hilbert.shard(nothing, 4, law).count() == 0
    with pytest.raises(ValueError):
        hilbert.shard(docs, 4, "other")


# ---- 8 ----


def brute_viterbi(text, scores, ids, byte_id):
    """Ids of the segmentation of least cost, word by word; ties go to the longest last piece."""
    out = []
    for w in re.findall("▁+[^▁]*", "▁" + text.replace(" ", "▁")) if text else []:
        best = [(0.0, 0)]
        for end in range(1, len(w) + 1):
            options = [(best[a][0] - scores[w[a:end]], a) for a in range(max(0, end - 32), end) if w[a:end] in scores]
            if w[end - 1] not in scores:
                options.append((best[end - 1][0] + piece_lattice.UNKNOWN_COST, end - 1))
            best.append(min(options))
        at, own = len(w), []
        while at:
            a = best[at][1]
            own = ([ids[w[a:at]]] if w[a:at] in ids else [byte_id + x for x in w[a:at].encode()]) + own
            at = a
        out += own
    return out


def test_pieces(spark, docs, nothing):
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = piece_lattice.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model")).cache()
    data = [(i, r[1]) for i, r in enumerate(rows(15))] + [(500 + n, " " * n + "x" + " " * (n + 3)) for n in range(1, 18)] + [(600, "😀 ▁x <s> <0x0A>"), (600, "twice"), (None, "no id"), (None, None), (700, "nospace" * 60)]
    rng = np.random.default_rng(5)
    data += [(800 + i, "".join(rng.choice(list(letters), size))) for i, (letters, size) in enumerate([("的一是不了人我在有他这", 40_000), ("abc日語テキスト😀", 3000), ("aeinst", 400), ("的", 300)])]
    data += [(1000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    small = spark.createDataFrame(data, "doc_id long, text string").withColumn("words", F.lit("clash"))
    coded = piece_lattice.encode(small, table, ("viterbi", "merges")).cache()
    want = collections.Counter((i, tuple(m.encode(t or ""))) for i, t in data)
    assert collections.Counter((r.doc_id, tuple(r.merges)) for r in coded.collect()) == want
    normal = {r.piece: r for r in table.collect() if r.kind == "normal"}
    scores, ids, byte_id = {p: r.score for p, r in normal.items()}, {p: r.id for p, r in normal.items()}, m.piece_to_id("<0x00>")
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in coded.collect()) == collections.Counter((i, tuple(brute_viterbi(t or "", scores, ids, byte_id))) for i, t in data)
    plain = collections.Counter((i, (t or "").replace("▁", " ")) for i, t in data)
    for column in ("ids", "merges"):
        assert collections.Counter(map(tuple, piece_lattice.decode(coded.select("doc_id", F.col(column).alias("ids")), table).collect())) == plain
    assert piece_lattice.encode(nothing, table).count() == 0
    with pytest.raises(ValueError):
        piece_lattice.encode(nothing, table, ("other",))


def test_pieces_move_no_words(spark):
    """Words are encoded where they stand: nothing is shuffled, also where batches are of
    empty texts, end with blanks or hold one long word."""
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = piece_lattice.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", " ", "a  ", " b", "", "▁", "x▁ y▁", "c" * 200 + " d", "\x00 é\n\t", "日本 語の" * 50, None, "  ", "􏿿😀 z", "t h e", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    coded = piece_lattice.encode(docs, table, ("merges", "viterbi"))
    assert "Exchange" not in coded._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.ids for r in coded.collect()}
    assert got == {i: m.encode(t or "") for i, t in enumerate(texts)}
    pieces = piece_lattice.Pieces(table.collect())
    for few in (texts[:1], [], texts[11:12]):
        words, n = piece_lattice.marked_words(pa.array(few, pa.string()))
        ids, bounds = pieces.encode(words, ("viterbi",))[0]
        assert len(n) == len(few) and len(bounds) == len(words) + 1 and bounds[-1] == len(ids)


def test_pieces_in_lots(spark, monkeypatch):
    """What a fold holds follows the lot, not the batch, and no lot changes an id, whichever
    objective comes first."""
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = piece_lattice.Pieces(piece_lattice.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model")).collect())
    rng = np.random.default_rng(3)
    words = pa.array(["▁" + "".join(x) for x in rng.choice(list("etaoinshrdlu"), (100_000, 9))])
    tracemalloc.start()
    whole = pieces.encode(words, ("merges", "viterbi"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 * pc.sum(pc.utf8_length(words)).as_py()  # bytes a character
    few = words[:300].to_pylist() + ["", "▁", "▁" + "日x😀" * 50, "▁" + "c" * 200, ""]
    monkeypatch.setattr(piece_lattice, "LOT", 7)
    small = pieces.encode(pa.array(few), ("viterbi", "merges"))[::-1]
    for (ids, at), (own, to) in zip(whole, small):
        assert [ids[x:y].tolist() for x, y in zip(at[:300], at[1:])] == [own[x:y].tolist() for x, y in zip(to[:300], to[1:])]
    own, to = small[0]
    assert [own[x:y].tolist() for x, y in zip(to, to[1:])] == [m.encode(w[1:]) or [m.piece_to_id(x) for x in w] for w in few]


def test_pieces_of_large_batches(spark):
    """A batch of more words than a lot, in several batches out; characters that are no UTF-8."""
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = piece_lattice.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    texts = [b"", b"the end of it " * 12_000, None, b"a\xffb \xed\xa0\x80", "é 日本".encode() * 9000, b"", b"one two " * 20_000, b" "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) as text").coalesce(1)
    got = {r.doc_id: r.merges for r in piece_lattice.encode(docs, table, ("viterbi", "merges")).collect()}
    assert got == {i: m.encode((t or b"").decode("utf-8", "replace")) for i, t in enumerate(texts)}


def test_viterbi(spark):
    """The best sum of scores, against all segmentations of short words."""
    scores = {"a": -3.0, "b": -3.5, "c": -2.0, "ab": -4.0, "bc": -5.5, "abc": -8.0, "ca": -4.9}
    table = spark.createDataFrame([("<unk>", 0, 0.0, True, "unknown")] + [(p, i + 1, s, True, "normal") for i, (p, s) in enumerate(scores.items())], "piece string, id int, score double, ordered boolean, kind string")
    words = ["a", "abc", "abcabc", "cab", "bcca", "cabcab"]
    out = {r.word: r.ids for r in piece_lattice.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table, ("viterbi",)).collect()}
    ids = {p: i + 1 for i, p in enumerate(scores)}

    def best(w):
        if not w:
            return 0.0
        return max(scores[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in scores)

    names = {i: p for p, i in ids.items()}
    for w in words:
        assert "".join(names[i] for i in out[w]) == w
        assert abs(sum(scores[names[i]] for i in out[w]) - best(w)) < 1e-9


# ---- 9 ----


def test_warc(spark, tmp_path):
    big = "é" * 600
    data = [(1, "http://a", big), (2, None, big), (9, "http://c\nx", big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "x" * 300_000), (9, "http://c", big), (2, "dup", "other" * 300)]
    path = "file://" + str(tmp_path / "w")
    manifest = warc.write_archives(spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("clash")), path)
    got = warc.read_archives(manifest, path, with_payload=True).collect()
    want = collections.Counter()
    for i, _, h in data:
        p = (h or "").encode()
        largest = max((x for x, _, y in data if x is not None and (y or "") == (h or "")), default=None)
        other = len(p) >= 1000 and i is not None and largest != i
        want[i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if other else "response", largest if other else None, None if other else p] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    empty = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(empty, path).count() == 0


def test_warc_members_and_faults():
    a, b = warc.record_bytes(1, "u", b"x" * 5000, None), warc.record_bytes(2, "u", b"y", 1)
    for chunk in (1, 7, 1 << 18):
        found = [warc.parse(m) for m in warc.members(io.BytesIO(a + b), chunk)]
        assert [h["warc-type"] for h, _ in found] == ["response", "revisit"]
        assert [warc.verified(*x)[0] for x in found] == [5000, 1]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(a[:-3])))
    header, block = warc.parse(next(warc.members(io.BytesIO(a))))
    with pytest.raises(ValueError):
        warc.verified(header, block[:-1] + b"z")
    with pytest.raises(ValueError):
        warc.parse(b"no record" + b"\r\n\r\n")


# ---- 10 ----


def brute_repeats(texts, window):
    words = [re.findall(WORDS.encode(), (t or "").encode()) for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()


@pytest.mark.parametrize("window,spread", [(35, 20), (10, 5), (6, 6)])
def test_repeats(docs, nothing, window, spread):
    data = rows()
    got = substring.remove_repeats(docs, window, spread)
    assert sorted(got.columns) == sorted({*docs.columns, "n_words", "n_removed", "kept", "spans"})
    want = collections.Counter((r[0], *x) for r, x in zip(data, brute_repeats([r[1] for r in data], window)))
    out = got.collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in out)
    assert substring.remove_repeats(nothing, window, spread).count() == 0
    with pytest.raises(ValueError):
        substring.remove_repeats(docs, 5, 9)


def test_repeats_of_rows_that_share_an_id(spark, monkeypatch):
    """Rows of one id with different texts stay apart, whatever 24 bits of their texts' hash say."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 45)) for _ in range(6000)]
    by = collections.defaultdict(list)
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(1 << 24)).alias("h")).collect():
        by[r.h].append(r.t)
    pairs = [v for v in by.values() if len(v) > 1][:3]
    assert pairs
    data = [(None, a) for a, _ in pairs] + [(None, b) for _, b in pairs] + [(7 + i, a) for i, (a, _) in enumerate(pairs)] + [(50, pairs[0][0]), (50, pairs[0][1])]
    want = collections.Counter((i, *x) for (i, _), x in zip(data, brute_repeats([t for _, t in data], 35)))
    out = substring.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == want


# ---- the pipeline ----


def test_pipeline(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lex = queries._learnt(spark, d)
    clean = cp.drop_toxic(spark, docs, d)
    scored = {r.doc_id: r.predicted for r in toxicity.score(docs, lex).collect()}
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and set(kept) == {i for i, p in scored.items() if not p}
    single = cp.drop_near_copies(spark, clean, d)
    left = {r.doc_id: r.text for r in single.collect()}
    assert single.columns == docs.columns
    sets = {i: set(minhash.shingles((t.lower()).encode()).tolist()) for i, t in kept.items()}
    inverted = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    shared = collections.Counter((a, b) for v in inverted.values() if len(v) < 200 for k, a in enumerate(sorted(v)) for b in sorted(v)[k + 1 :])
    like = {p: n / len(sets[p[0]] | sets[p[1]]) for p, n in shared.items()}
    close = [p for p, j in like.items() if j >= 0.8]
    assert sum(b not in left for a, b in close) >= 0.9 * len(close) > 0
    best = collections.defaultdict(float)
    for (a, b), j in like.items():
        best[b] = max(best[b], j)
    assert all(best[i] > 0.6 or kept[i] in {kept[j] for j in kept if j < i} for i in kept if i not in left)
    cut = cp.drop_repeats(spark, single, d)
    got = {r.doc_id: r.text for r in cut.collect()}
    ids = list(left)
    want = dict(zip(ids, brute_repeats([left[i] for i in ids], 35)))
    assert {i: (t if want[i][1] else left[i]) for i, t in got.items()} == got
    assert all(got[i] == (want[i][2] if want[i][1] else left[i]) for i in ids)
    check_packing(cp.pack(spark, cut, d).collect(), list(got.items()))


def test_pipeline_odd_rows(spark, docs, nothing):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    for table in (docs, nothing):
        out = table.select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("predicted"), F.lit(2).alias("component_id"))
        for _, stage in cp.STAGES:
            out = common.stored(stage(spark, out, d), "s")
        assert out.count() > 0 or table is nothing


def shifted_pairs(n, more, at=0):
    """Pairs (id, text) of texts of which the second starts some words later than the first;
    the shingle similarity is the least of 0.8 or more, and with ``more`` words below it."""
    rng, out = np.random.default_rng(11 + more), []
    for i in range(n):
        size = int(rng.integers(60, 200))
        k = size // 9 + more
        words = [f"w{x}" for x in rng.integers(0, 10**9, size + 4 + k)]
        assert ((size - k) / (size + k) >= 0.8) == (not more)
        out += [(at + 2 * i, " ".join(words[: size + 4])), (at + 2 * i + 1, " ".join(words[k:]))]
    return out


def pipeline_docs(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_finds_every_near_copy(spark):
    import corpus_pipeline as cp

    docs = pipeline_docs(spark, shifted_pairs(400, 0))
    left = [r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()]
    assert sorted(left) == list(range(0, 800, 2))


def test_pipeline_links_by_simhash_first(spark, monkeypatch):
    import corpus_pipeline as cp

    rng = np.random.default_rng(5)
    pairs = []
    for i in range(0, 40, 2):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 400)]
        pairs += [(i, " ".join(words)), (i + 1, " ".join(words[:-1] + ["other"]))]
    monkeypatch.setattr(shingle_join, "candidates", lambda *a: spark.createDataFrame([], "a long, b long"))  # nothing by the join
    left = [r.doc_id for r in cp.drop_near_copies(spark, pipeline_docs(spark, pairs), "").collect()]
    assert sorted(left) == list(range(0, 40, 2))


def test_pipeline_keeps_what_is_no_near_copy(spark):
    import corpus_pipeline as cp

    rng = np.random.default_rng(3)
    template = [f"t{i}" for i in range(140)]
    own = [[f"o{x}" for x in rng.integers(0, 10**9, 30)] for _ in range(60)]
    pairs = shifted_pairs(200, 1) + [(1000 + i, " ".join(template + w)) for i, w in enumerate(own)]  # no two at 0.8, many at 0.7
    pairs += [(2000 + i, " ".join(f"s{x}" for x in rng.integers(0, 10**9, 6))) for i in range(100)] + [(2100, ""), (2101, None)]
    again = [(0, "another text of the first id"), (0, pairs[0][1]), (2100, ""), (None, pairs[0][1]), (2099, pairs[0][1].upper())]
    left = cp.drop_near_copies(spark, pipeline_docs(spark, pairs + again), "").collect()
    assert collections.Counter((r.doc_id, r.text) for r in left) == collections.Counter(pairs[:-1] + [again[0], again[3]])


def broadcasts(monkeypatch, run):
    """The plans, of all tables stored by a run and of its result, in which something is broadcast."""
    plans, kept = [], common.stored
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(common, "stored", lambda df, name: (plan(df), kept(df, name))[1])
    out = run()
    plan(out)
    rows = out.count()
    assert rows and len(plans) > 5 and any("SortMergeJoin" in p for p in plans)
    return [p for p in plans if "Broadcast" in p]


def test_simhash_broadcasts_nothing(spark, docs, monkeypatch):
    assert not broadcasts(monkeypatch, lambda: simhash.near_duplicates(docs, words=4, radius=4))


def test_near_copies_broadcast_nothing(spark, docs, monkeypatch):
    import corpus_pipeline as cp

    monkeypatch.setattr(shingle_join, "SMALL", 2)
    assert not broadcasts(monkeypatch, lambda: cp.drop_near_copies(spark, docs, ""))


@pytest.mark.parametrize("block", [512, 2])
def test_shingle_join(spark, docs, nothing, monkeypatch, block):
    monkeypatch.setattr(shingle_join, "HOT", 30)
    monkeypatch.setattr(shingle_join, "SMALL", 2)
    got = shingle_join.near_duplicates(docs, 2, Fraction(3, 10), block).collect()
    kinds = [r for r in rows() if r[0] is not None]
    sets = [set(minhash.shingles((r[1] or "").encode().lower(), 2).tolist()) for r in kinds]
    group = list(range(len(kinds)))
    for a in range(len(kinds)):
        for b in range(a):
            if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    names = spark.createDataFrame([(r[1] or "",) for r in kinds], "t string").select("t", F.xxhash64("t").alias("tag")).collect()
    tags = {r.t: r.tag for r in names}
    found = {(r.doc_id, r.tag): r.component_id for r in got}
    assert len(got) == len(kinds) and len(set(group)) < len(set(found)) > 60
    at = [found[r[0], tags[r[1] or ""]] for r in kinds]
    assert len(set(zip(group, at))) == len(set(group)) == len(set(at))
    assert shingle_join.near_duplicates(nothing).count() == 0


def test_bucket_pairs():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (3, 60, 200, 255, 600)]
    sets = [np.unique(np.concatenate([b[: rng.integers(len(b) * 3 // 4, len(b) + 1)], rng.integers(0, 2**63, rng.integers(0, 1 + len(b) // 5), dtype=np.uint64)])) for b in base for _ in range(12)]
    size, maps = np.array([len(s) for s in sets]), [shingle_join.shingle_map(s).tobytes() for s in sets]
    near = {(a, b) for a in range(len(sets)) for b in range(a) if shingle_join.alike(sets[a], [sets[b]], Fraction(4, 5))[0]}
    assert near == {(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    side, known = rng.integers(0, 2, len(sets)), rng.integers(0, 5, len(sets))
    apart = np.arange(len(sets))
    for s, k in ((None, apart), (side, apart), (side, known), (None, known)):
        every = {(a, b) for a, b in near if (s is None or s[a] != s[b]) and k[a] != k[b]}
        got = {(max(e), min(e)) for e in shingle_join.bucket_pairs(size, maps, s, k, Fraction(4, 5))}
        assert every <= got and len(got) < 2 * len(every)
    for k in (apart, known):
        some = shingle_join.group_links(sets, k, Fraction(4, 5))
        assert all((max(e), min(e)) in near and k[e[0]] != k[e[1]] for e in some)
        same = [(int(np.flatnonzero(k == x)[0]), int(y)) for x in np.unique(k) for y in np.flatnonzero(k == x)]
        assert len(some) < len(sets) and joined(some + same, len(sets)) == joined(list(near) + same, len(sets))


def joined(edges, n):
    group = list(range(n))
    for a, b in edges:
        group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    return group
