"""The registered queries against their SQL, and the pipeline against its stages."""

import hashlib
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from sparkdod.llm import bpe, queries
from sparkdod.llm.common import documents


def test_all_are_registered():
    names = set(E.queries())
    assert {q.split("_")[0] for q in names if q.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in names and set(queries.ORACLE) <= names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf001, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{os.path.join(sf001, 'documents.parquet')}')")
    want = con.execute(queries.ORACLE[name]).df()
    got = E.queries()[name](spark, sf001).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_pipeline_stages(spark, sf001, tmp_path):
    docs = documents(spark, sf001)
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf001)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(path := str(tmp_path / name))
            docs = spark.read.parquet(path)
            kept.append([r["doc_id"] for r in docs.collect()])
            assert all(docs_row == rows[docs_row["doc_id"]] for docs_row in docs.collect())
    clean, exact, near, mixed = kept
    strip = lambda t: "".join(t.split())
    assert sorted({strip(rows[i]["text"]) for i in exact}) == sorted({strip(rows[i]["text"]) for i in clean}) and len(exact) == len({strip(rows[i]["text"]) for i in clean})
    assert set(near) <= set(exact) <= set(clean) and len(near) == len(set(near))
    assert set(mixed) <= set(near) and max(Counter(mixed).values()) <= 3
    tok = bpe.load(open(bpe.default_path(), encoding="utf-8").read())
    want = Counter((i, hashlib.sha256(tok.encode(rows[i]["text"])).hexdigest()) for i in mixed)
    assert Counter((r["doc_id"], hashlib.sha256(r["ids"]).hexdigest()) for r in out.collect()) == want


def test_pipeline_query_agrees(spark, sf001):
    one = sorted((r["doc_id"], r["n_tokens"]) for r in E.queries()["pipeline"](spark, sf001).collect())
    two = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf001).collect())
    assert one == two and one
