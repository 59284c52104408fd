"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, filter_audit, hilbert, maxscore, minhash, packing, periodic, piece_lattice, simhash, substring, superminhash, token_store, toxicity, warc

HELD_OUT = 1
"""Documents whose crc32 of the id leaves this remainder by 3 are never learnt from."""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as binary files and read back."""
    path = common.new_path(spark, "tokens")
    manifest = token_store.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), "word", 2)
    return token_store.read_token_files(spark, path, manifest, with_ids=False)


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products for every 20th vector."""
    vectors = maxscore.quantised(_table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    cut = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "byte", 2, 1024)
    return packing.pack(cut, 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit fingerprints over 4-word shingles, and components at 4 bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, bits=64, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text."""
    return minhash.fingerprint_edits(_table(spark, sf_dir, "documents"))


def _learnt(spark: SparkSession, sf_dir: str) -> toxicity.Lexicon:
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    labels = _table(spark, sf_dir, "labels").filter(remainder != HELD_OUT).select("doc_id", "toxic")
    return toxicity.train(_table(spark, sf_dir, "documents"), labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    scored = toxicity.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), _learnt(spark, sf_dir), 0.7)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards along a Hilbert curve, equal in rows."""
    found = hilbert.shard(_table(spark, sf_dir, "documents"), 8, "rows")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document: the best sum of scores, and the model's own merges."""
    table = common.checkpoint(piece_lattice.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model")))
    return piece_lattice.encode(_table(spark, sf_dir, "documents"), table, ("viterbi", "merges"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC records and read back."""
    path = common.new_path(spark, "warc")
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages"), path), path)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without words of repeated 35-word windows."""
    kept = substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), 35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents at a similarity of 0.85 of their 5-word shingles."""
    return superminhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), 5, Fraction(85, 100))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in every order, by language."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"), "toxic")
    counted = filter_audit.masks(_table(spark, sf_dir, "documents"), filter_audit.text_failures(), "E", "lang", labels)
    return filter_audit.audit(counted, list("ABCDE"))


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), in one of ten with the words from some place on replaced by
    repeats of the first of them, as the contract of op13 draws them from the doc_id (a
    null one: never)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", filter_audit.SPACE), lambda w: w != "")
    a = F.pmod(F.col("g"), F.size("words"))
    p = 1 + F.floor((F.size("words") - F.col("a")) / (3 + F.pmod(F.col("g"), F.lit(8))))

    def source(i: Column) -> Column:
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))

    drawn = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    drawn = drawn.withColumn("a", F.when(F.size("words") > 0, a)).withColumn("p", p)
    spread = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", source(i).cast("int")))
    return drawn.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(spread, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 12 words or more of all documents, and what is left without their repeats."""
    found = periodic.find_runs(planted(_table(spark, sf_dir, "documents").select("doc_id", "text")), 12)
    order = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    best = F.get(order, F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    longest = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = -F.col("b.l"), F.col("b.p")
    return longest.select("doc_id", "n_runs", F.col("b.s").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline at the repository's top."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_maxscore": op2_maxscore,
    "op3_best_fit": op3_best_fit,
    "op4_simhash": op4_simhash,
    "op5_minhash": op5_minhash,
    "op6_toxicity": op6_toxicity,
    "op7_hilbert": op7_hilbert,
    "op8_piece_lattice": op8_piece_lattice,
    "op9_warc": op9_warc,
    "op10_substring": op10_substring,
    "op11_superminhash": op11_superminhash,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op2_maxscore": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN original <> page_id THEN original END AS refers_to
        FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND p.payload_bytes >= 1000
    """,
    "op10_substring": """
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        win AS (
            SELECT doc_id, s, array_to_string(words[s:s + 34], ' ') AS seq
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS s FROM w WHERE len(words) >= 35)),
        twice AS (SELECT seq FROM win GROUP BY seq HAVING count(*) > 1),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM win SEMI JOIN twice USING (seq)),
        each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
    """,
    "op11_superminhash": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s FROM w),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
        both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
        reached AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION
            SELECT r.x, l.y FROM reached r JOIN both_ways l ON r.y = l.x),
        components AS (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN components c ON d.doc_id = c.doc_id
    """,
    "op12_filter_audit": """
        WITH t AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        first AS (SELECT text, min(doc_id) AS lowest FROM t GROUP BY text),
        flags AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        failed AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   concat(CASE WHEN len(words) < 100 THEN 'A' ELSE '' END,
                          CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
                          CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]+', '', 'g')) > 10 * length(t.text) THEN 'C' ELSE '' END,
                          CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END,
                          CASE WHEN t.doc_id > lowest THEN 'E' ELSE '' END) AS f
            FROM t JOIN first ON t.text = first.text LEFT JOIN flags ON t.doc_id = flags.doc_id),
        counted AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
        letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        orders AS (
            SELECT concat(a.l, b.l, c.l, d.l, e.l) AS o FROM letter a, letter b, letter c, letter d, letter e
            WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
        steps AS (SELECT o, step, o[step] AS l FROM orders, (SELECT unnest(range(1, 6)) AS step)),
        removals AS (
            SELECT part, f, n, good, toxic, o, min(step) AS gone_at FROM counted JOIN steps ON contains(f, l) GROUP BY ALL),
        sums AS (SELECT part, o, gone_at, sum(n) AS removed, sum(good) AS good_lost, sum(toxic) AS toxic_lost FROM removals GROUP BY ALL),
        totals AS (SELECT part, sum(n) AS total FROM counted GROUP BY part),
        alone AS (SELECT part, l, sum(n) AS failing, sum(CASE WHEN f = l THEN n ELSE 0 END) AS only_one FROM counted JOIN letter ON contains(f, l) GROUP BY ALL),
        exact AS (
            SELECT s.part, s.o AS filter_order, s.step, s.l, total, coalesce(removed, 0) AS removed, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
                   coalesce(failing, 0) AS failing, coalesce(only_one, 0) AS only_one
            FROM (SELECT * FROM totals CROSS JOIN steps) s LEFT JOIN sums x ON s.part = x.part AND s.o = x.o AND s.step = x.gone_at LEFT JOIN alone y ON s.part = y.part AND s.l = y.l)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step,
               CAST(total - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step) AS BIGINT) AS kept,
               CAST(removed AS BIGINT) AS removed, CAST(failing - removed AS BIGINT) AS redundant, CAST(only_one AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
        FROM exact
    """,
}
