"""The registered queries of this package: each a thin digest of what its operator returns, over whole tables."""
from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payproof.scale import shared_folder
from payproof.llm import bpe, decontaminate, embeddings, minhash, mixing, packing, phrases, quality, ranked, rollups, rules, substrings, suffixes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_substring_dedup", """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i, w FROM words WHERE len(w) >= 13
), grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM starts
), lowest AS (SELECT g, min(doc_id) AS lo FROM grams GROUP BY g
), hit AS (
  SELECT DISTINCT doc_id, i + unnest(generate_series(0, 12)) AS p FROM grams JOIN lowest USING (g) WHERE lo < doc_id
), gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w
                                   ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return (substrings.remove_repeats(table(spark, folder, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")))


@query("op2_minhash_near_dedup", """
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes s ON s.doc_id = p.a JOIN sizes t ON t.doc_id = p.b WHERE 100 * common >= 85 * (s.n + t.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = w.doc_id""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op3_byte_bpe")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(table(spark, folder, "documents"), VOCABULARY, public_tokenizers.PATTERN, check=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


PLAIN_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
END = 50256                                                    # free in that vocabulary


def _library_encoder(content: bytes, pattern: str):
    """The tokenizer library, made once in each worker."""
    def make():
        import tiktoken
        if content not in _ENCODERS:
            _ENCODERS[content] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=bpe.read_ranks(content), special_tokens={})
        return _ENCODERS[content].encode_ordinary
    return make


_ENCODERS: dict = {}


@query("op4_packed_rows")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """The packed rows themselves."""
    encoder = _library_encoder(Path(PLAIN_VOCABULARY).read_bytes(), public_tokenizers.PATTERN)
    return packing.pack(table(spark, folder, "documents"), encoder, END)


@query("op5_curriculum_mix", """
WITH docs AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS turn FROM documents
), sources AS (
  SELECT source, sum(size) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM docs GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM sources WINDOW w AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shares AS (
  SELECT source, source_size, CASE rank % 2 WHEN 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END AS start, CASE rank % 2 WHEN 1 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS slope,
    least(CAST(3 * source_size AS DOUBLE), coalesce(weight * (
    SELECT arg_min(level, 3 * source_size / CAST(weight AS DOUBLE)) FROM levels WHERE level * weight <= 3 * source_size), 0)) AS target FROM sources
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY turn, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM docs
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(list_sum([greatest(0, least(size, CAST(round(target) AS BIGINT) - p * source_size - begin)) FOR p IN [0, 1, 2]]) AS BIGINT) AS taken,
       CASE WHEN least(size, CAST(round(target) AS BIGINT) - begin) > 0 THEN (sqrt(start * start + 2 * slope * least(begin / target, 1.0)) - start) / slope END AS position
FROM placed JOIN shares ON placed.source IS NOT DISTINCT FROM shares.source""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """In training order: range-sorted by the progress of the run at which a document's first pass begins, documents not taken first."""
    planned = mixing.plan(table(spark, folder, "documents"), ["doc_id"]).withColumn("position", F.get("passes", F.lit(0))["position"])
    return planned.drop("passes").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


@query("op6_quality_rules")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judged(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """With what is left of each text."""
    return (suffixes.remove_repeats(table(spark, folder, "documents"))
            .select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"),
                    F.col("kept_text").alias("text")))


@query("op8_quality_classifier")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    scored, _ = rules.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op9_embedding_near_dedup", """
WITH RECURSIVE fine AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_inner_product(x.v, y.v) >= 0.93 * sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = e.vec_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = e.vec_id""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query("op10_token_rollups", """
WITH counted AS (
  SELECT doc_id, source, lang, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS words,
         CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes, doc_id > min(doc_id) OVER (PARTITION BY md5(text)) AND text IS NOT NULL AS copy FROM documents
)
SELECT source, lang, 'words-2' AS version, count(*) AS docs, CAST(sum(words) AS BIGINT) AS tokens FROM counted WHERE NOT copy GROUP BY ALL
UNION ALL SELECT source, lang, 'bytes-1', count(*), CAST(sum(bytes) AS BIGINT) FROM counted WHERE NOT copy GROUP BY ALL""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Four batches over all documents, the second of them twice: counts of bytes and a first count of words (line ends not taken for
    spaces); revised word counts under the next version, the first version taken out; copies of earlier documents deleted."""
    docs = table(spark, folder, "documents").where("doc_id IS NOT NULL")
    counted = docs.select("doc_id", "source", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), mixing.words_in(F.col("text")).alias("words"),
                          F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("long").alias("rough"), F.md5("text").alias("content"))
    rollup = rollups.Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    counted = rollups.written(rollup, "counted", counted)
    event = lambda rows, version, kind, tokens: rows.select("doc_id", "source", "lang", F.lit(version).alias("version"), F.lit(kind).alias("kind"), F.col(tokens).alias("tokens"))
    first = event(counted, "bytes-1", "insert", "bytes").union(event(counted, "words-1", "insert", "rough"))
    second = event(counted, "words-1", "delete", "rough").union(event(counted, "words-2", "insert", "rough"))
    third = event(counted, "words-2", "revise", "words")
    lowest = counted.where("content IS NOT NULL").groupBy("content").agg(F.min("doc_id").alias("lowest"))
    copies = counted.join(lowest, "content").where("doc_id > lowest")
    fourth = event(copies, "words-2", "delete", "words").union(event(copies, "bytes-1", "delete", "bytes"))
    for number, events in ((1, first), (2, second), (2, second), (3, third), (4, fourth), (3, third)):
        rollup.commit(number, events)
    return rollup.totals()


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op11_decontaminate", f"""
WITH words AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents
), items AS (SELECT item_id, {_WORDS} AS w FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)
), found AS MATERIALIZED (
  SELECT doc_id, i, k, g FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
    SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k))
  WHERE g IN (SELECT g FROM windows)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(generate_series(0, k - 1)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found JOIN windows USING (k, g)) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id)""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"),
                        decontaminate.digest(F.col("leak.items")).alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated"))


@query("op12_phrases", """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k))
  GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, phrase, max(a) AS b FROM (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM f WHERE k = 3) GROUP BY ALL
), cuts AS (
  SELECT lang, phrase, a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS x, array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') AS y
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM f LEFT JOIN longer USING (lang, phrase) WHERE k > 1 AND coalesce(100 * b < 50 * a, true))
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, c, l.a AS l, r.a AS r, CAST(1000000::HUGEINT * cuts.a * cuts.a // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.phrases(table(spark, folder, "documents"))


@query("op13_ranked_search", f"""
WITH terms AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL
), lengths AS MATERIALIZED (SELECT doc_id, sum(tf) AS n FROM terms GROUP BY doc_id
), whole AS (SELECT count(*) AS docs, sum(n) AS words FROM lengths
), items AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM terms, whole WHERE term IN (SELECT term FROM items) GROUP BY term
), worth AS MATERIALIZED (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + CAST((50 * n * docs) // words AS BIGINT)))) AS v
  FROM terms JOIN weights USING (term) JOIN lengths USING (doc_id), whole
), scores AS (SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM items JOIN worth USING (term) GROUP BY ALL HAVING sum(v) > 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
