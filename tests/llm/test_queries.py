"""The registered queries over the smallest tables: against DuckDB where there is SQL, else their shape."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sluice.llm import decontamination, line_dedup, packing, queries, simhash
from sluice.llm.compression_classifier import CompressionClassifier
from sluice.llm import common

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
COLUMNS = {
    "op1_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op2_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op3_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op4_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5_simhash": ["doc_id", "fingerprint", "component_id"],
    "op6_decontamination": ["doc_id", "item_id", "containment"],
    "op7_line_dedup": ["doc_id", "n_lines", "n_removed", "kept_sha256"],
    "op8_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op9_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
}


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()  # bytes: ASCII only
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    df = entry.queries()[name](spark, str(DATA))
    assert set(COLUMNS[name]) <= set(df.columns)
    rows = df.collect()
    table = "pages" if name == "op3_html_extraction" else "documents"
    if name not in ("op1_packing", "op6_decontamination"):
        assert len(rows) == spark.read.parquet(str(DATA / f"{table}.parquet")).count()
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "labels", "pages"):
            path = DATA / f"{t}.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
        found = con.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in found.description]
        expected = [tuple(dict(zip(columns, r, strict=True))[c] for c in sorted(columns)) for r in found.fetchall()]
        assert sorted(expected, key=str) == sorted((tuple(r[c] for c in sorted(columns)) for r in rows), key=str)


def test_pipeline_stage_by_stage(spark):
    """Every stage against the operator's plain meaning on what the stage before has kept."""
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.staged(stage(spark, docs, str(DATA)), f"test-{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
        if name == "quality_classifier":
            model = CompressionClassifier.fit(before, spark.read.parquet(str(DATA / "labels.parquet")), allowed=common.crc32_of_id() % 5 != 0)
            rows = before.collect()
            p = model.probability([r["text"].encode() for r in rows])
            assert ids(docs) == {r["doc_id"] for r, s in zip(rows, p, strict=True) if s >= 0.3}
        elif name == "line_dedup":
            plain = {r["doc_id"]: r["text"] for r in line_dedup.without_boilerplate(before).collect()}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == plain and len(plain) == before.count()
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        elif name == "near_dedup":
            prints = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode()) for r in before.collect()}
            order, parent = sorted(prints), {i: i for i in prints}
            sets = {r["doc_id"]: shingle_set(r["text"]) for r in before.collect()}

            def root(n):
                while parent[n] != n:
                    n = parent[n]
                return n

            for i, a in enumerate(order):
                for b in order[i + 1 :]:
                    if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 4 or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
            assert ids(docs) == {i for i in order if root(i) == i}
        elif name == "decontamination":
            items = [decontamination.shingles(r["text"]) for r in spark.read.parquet(str(DATA / "benchmark.parquet")).collect()]
            clean = {r["doc_id"] for r in before.collect() if not any(len(s & decontamination.shingles(r["text"])) >= 0.8 * len(s) - 1e-9 for s in items)}
            assert ids(docs) == clean
        else:
            encode = packing.tokenizer(queries.tokenizer_path())
            lengths = {r["doc_id"]: len(encode.ids(r["text"])) + 1 for r in before.collect()}
            assert {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == lengths
    assert corpus_pipeline.run(spark, str(DATA)).groupBy().sum("length").first()[0] == kept["packing"].groupBy().sum("length").first()[0]
