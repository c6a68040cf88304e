"""Registered queries against their SQL, and the pipeline."""
import duckdb
import pytest

import corpus_pipeline
from payproof.llm import bpe, minhash, quality, queries, suffixes

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels", "benchmark")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want.project(", ".join(cols)).fetchall()))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stay = {r.doc_id for r in quality.judged(docs).where("quality.kept").collect()}
    kept = docs.where(docs.doc_id.isin([int(i) for i in stay]))
    first = {r.doc_id for r in minhash.near_duplicates(kept, percent=80).where("kept").collect()}
    after = {r.doc_id: r.text for r in suffixes.without_repeats(docs.where(docs.doc_id.isin([int(i) for i in first])), 200, 51).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and {r.doc_id for r in got} <= set(after) <= first <= stay <= set(texts)
    coder = bpe.Coder(bpe.read_ranks(open(queries.VOCABULARY, "rb").read()), queries.public_tokenizers.PATTERN)
    for r in got:
        assert after[r.doc_id].startswith(coder.decode(bytes(r.ids)).decode()) and r.n_tokens == len(r.ids) // 4
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "suffix-array dedup", "source mix", "byte-level BPE"]
