import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from canopy.llm import bpe, langid, minhash, mixing, quality
from canopy.llm.common import fold
from canopy.llm.queries import QUERIES, tokenizer_path

DATA = os.environ.get("CANOPY_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="provided tables not found")


@needs_data
def test_run_equals_the_operators_one_after_the_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lang = {r.doc_id for r in langid.identify(docs, fold("doc_id") != 0).collect() if not r.rejected}
    docs = docs.where(docs.doc_id.isin(list(lang)))
    good = {r.doc_id for r in quality.quality(docs).collect() if r.kept}
    docs = docs.where(docs.doc_id.isin(list(good)))
    once = {r.doc_id for r in minhash.near_duplicates(docs, percent=pipeline.NEAR_PERCENT).collect() if r.kept}
    docs = docs.where(docs.doc_id.isin(list(once)))
    taken = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()}
    ids = {r.doc_id: bytes(r.ids) for r in bpe.tokenize(docs, bpe.read_spec(tokenizer_path())).collect()}
    want = sorted((i, ids[i]) for i, n in taken.items() for _ in range(n))
    got = sorted((r.doc_id, bytes(r.ids)) for r in pipeline.run(spark, DATA).collect())
    assert got == want and 0 < len(once) < len(good) < len(lang)


def test_odd_rows_go_through_all_stages(spark, documents, odd_rows):
    docs = documents(odd_rows).select(*pipeline.COLUMNS)
    for start in (docs, docs.limit(0)):
        df = start
        for name, stage in pipeline.STAGES:
            df = stage(spark, df, DATA)
            if name != "tokens":
                assert df.columns == list(pipeline.COLUMNS)
        df.count()


def test_repeated_rows_and_rows_without_id_in_the_near_duplicate_stage(spark, documents, odd_rows):
    docs = documents(odd_rows).select(*pipeline.COLUMNS)
    got = sorted(str(r.doc_id) for r in pipeline.deduplicate(spark, docs, DATA).collect())
    assert got == ["1", "2", "3", "4", "5", "6", "7", "8", "None", "None"]


def test_no_text_is_lost_where_ids_come_with_several_texts(spark, documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, b, "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (5, a, "en", "s"), (7, c, "en", "s"), (7, None, "en", "s"), (9, c + " more", "en", "s")]
    got = [(r.doc_id, r.text) for r in pipeline.deduplicate(spark, documents(rows).select(*pipeline.COLUMNS), DATA).collect()]
    assert sorted(got, key=str) == sorted([(3, b), (5, a), (7, c), (7, None)], key=str)


def test_the_near_duplicate_stage_links_from_a_similarity_of_80_percent(spark, documents):
    words = [f"w{i}" for i in range(104)]
    near = [*words[:30], "new", *words[31:70], "other", *words[71:]]  # 90 of 110 shingles in common
    far = [*words[:30], "new", *words[31:50], "third", *words[51:70], "other", *words[71:]]  # 85 of 115 with the first
    rows = [(1, " ".join(words), "en", "a"), (2, " ".join(near), "en", "a"), (3, " ".join(f"x{w}" for w in far), "en", "a")]
    docs = documents(rows).select(*pipeline.COLUMNS)
    assert sorted(r.doc_id for r in pipeline.deduplicate(spark, docs, DATA).collect()) == [1, 3]
    docs = documents([rows[0], (4, " ".join(far), "en", "a")]).select(*pipeline.COLUMNS)
    assert sorted(r.doc_id for r in pipeline.deduplicate(spark, docs, DATA).collect()) == [1, 4]


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_returns_whole_tables(spark, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    assert got
    table = {"op1_main_text": "pages", "op5_near_vectors": "embeddings", "op12_whitening": "embeddings", "op2_chat_roles": "conversations"}.get(name, "documents")
    if name == "op2_chat_roles":  # turns are the model's finding: every line of every given turn is in one of them
        lines = spark.read.parquet(f"{DATA}/{table}.parquet").selectExpr("sum(size(split(coalesce(text, ''), '\n'))) AS n").first()["n"]
        assert sum(r["n_lines"] for r in got) == lines
    elif name != "op6_license_scan":
        per_row = 8 if name == "op12_whitening" else 1
        assert len(got) == per_row * spark.read.parquet(f"{DATA}/{table}.parquet").count()
    sql = entry.oracle_sql().get(name)
    if sql:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(result.fetchall())


def test_mixing_runs_no_python(spark, documents, odd_rows):
    plan = mixing.mixed(documents(odd_rows))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
