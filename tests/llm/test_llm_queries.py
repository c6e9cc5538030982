"""The registered queries on the smallest tables, and the pipeline against plain versions of its stages."""

import collections

import duckdb
import pytest

import corpus_pipeline
from firnline.llm import decontamination, jaccard_join, quality, secrets
from firnline.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
CONTRACT = {
    "op2": "doc_id n_words n_hit n_items items_sha256 contaminated", "op3": "doc_id piece start length ids_crc32 sequence_id offset", "op4": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5": "doc_id n_shingles component_id", "op6": "doc_id n_assign n_access n_hex base_sha256 spans", "op7": "doc_id held_out score predicted", "op8": "doc_id size text_crc32 law shard slot grown_shard",
    "op9": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op10": "page_id url text n_chars", "op1": "n_tokens n_docs",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_covers_its_table(spark, name):
    df = QUERIES[name](spark, DATA)
    assert set(CONTRACT[name.split("_")[0]].split()) <= set(df.columns)
    rows = df.collect()
    if "doc_id" in df.columns:
        assert {r["doc_id"] for r in rows} == {r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = con.sql(ORACLE_SQL[name])
        order = sorted(df.columns)
        assert order == sorted(want.columns)
        plain = [tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()]
        assert sorted(map(repr, plain)) == sorted(repr(tuple(r[c] for c in order)) for r in rows)


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    held = {r["doc_id"]: r for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, DATA)
        assert kept.columns == docs.columns
        now, then = {r["doc_id"]: r for r in kept.collect()}, {r["doc_id"] for r in before.collect()}
        if name == "quality classifier":
            good = {r["doc_id"] for r in quality.score(before, labels).where("predicted = 1").collect()}
            assert set(now) == good
        elif name == "n-gram Jaccard join":
            assert set(now) == {r["component_id"] for r in jaccard_join.join(before).collect()}
        elif name == "benchmark decontamination":
            assert set(now) == {r["doc_id"] for r in decontamination.report(before, items).where("NOT contaminated").collect()}
        else:
            assert set(now) == then
            found = {r["doc_id"]: r["spans"] for r in secrets.find(before).collect()}
            assert all((now[i]["text"] == held[i]["text"]) == (not found[i]) and now[i]["n_chars"] == len(now[i]["text"]) for i in now)
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, DATA).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in kept.collect()}
    bins = collections.defaultdict(int)
    for r in pieces:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048


def test_empty_tables_give_no_rows(spark, tmp_path):
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in {**QUERIES, "pipeline": corpus_pipeline.run}.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_nulls_in_every_column(spark, tmp_path):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    rows = [(None, None, None, None, None), (None, "a b c d e", None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "w " * 30_000, "en", "s", 60_000)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    for t, r in (("labels", [(None, None, None), (1, None, 0), (2, 1, None)]), ("benchmark", [(None, None), (1, None), (None, "a b"), (7, "a b c")]), ("pages", [(None, None, None), (1, None, "<p>x")])):
        spark.createDataFrame(r, spark.read.parquet(f"{DATA}/{t}.parquet").schema).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in {**QUERIES, "pipeline": corpus_pipeline.run}.items():
        n = query(spark, str(tmp_path)).count()
        if name not in ("op1_token_counts", "op3_best_fit_packing", "pipeline"):
            assert n == (2 if name.startswith("op10") else len(rows)), name
