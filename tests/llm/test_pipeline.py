"""The pipeline against its stages by brute force, and the registered SQL."""

import duckdb
import public_tokenizers
import pytest
from llm_tables import clashing, documents, frame, odd_rows  # noqa: F401
from test_linededup import rebuilt
from test_quality import brute as quality_brute
from test_simhash import brute_components, brute_print
from tokenizers import Tokenizer

import corpus_pipeline
from jobsift.llm import pii, quality, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    kept = {r[0] for r in quality_brute(documents, quality.REACH, quality.PRIOR) if r[-1]}
    rows = [r for r in documents if r[0] in kept]
    texts = dict(rebuilt(rows))
    near = brute_components([(i, brute_print(x)) for i, x in texts.items()])
    texts = {i: pii.redact(texts[i]) for i in {c for _, _, c in near}}
    want = {i: len(library.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id: p.doc_tokens for p in got} == want
    assert sum(p.length for p in got) == sum(want.values())


def test_stages_take_odd_and_empty_tables(spark):
    for df in (clashing(frame(spark, odd_rows())), frame(spark, odd_rows()).where("false")):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
