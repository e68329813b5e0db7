"""The whole pipeline against plain versions of its stages, and the SQL of the queries that have it."""

import brute
import pytest
from compare import connect, oracle_rows, rows_of
from test_similarity import similar

import corpus_pipeline
from quarrystone.llm import queries

FOLDER = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(rows, bench):
    good = [r for r, q in zip(rows, brute.quality(rows)) if q[-1]]
    cut = [(r[0], t, r[2], r[3], len(t) if t != r[1] else r[4]) for r, (_, _, _, t) in zip(good, brute.drop_lines(good))]
    first = brute.keep_first(cut, similar)
    clean = [r for r, x in zip(first, brute.leaks(first, bench)) if not x[-1]]
    places = {x[0]: (x[3], x[6]) for x in brute.mix(clean)[0]}
    return [(*r, *places[r[0]]) for r in clean]


def test_pipeline(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(*NAMES).collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    brute.same(corpus_pipeline.run(spark, FOLDER), plain(rows, bench), [*NAMES, "slot", "place"])


def test_stages_take_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(brute.corpus(9, 200, 60), brute.SCHEMA)
    docs = docs.selectExpr("*", "1 AS slot", "'k' AS kept", "2 AS fp", "3 AS place")
    for given in (docs, docs.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, given, FOLDER)
            last = k == len(corpus_pipeline.STAGES) - 1
            assert out.columns[: len(docs.columns)] == docs.columns and (last or len(out.columns) == len(docs.columns))
            out.write.parquet(path := f"{tmp_path}/{name}-{given is docs}")
            given_next = spark.read.parquet(path)
            if last:
                assert given_next.columns[-2:] == ["slot_", "place_"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == oracle_rows(connect(FOLDER), queries.ORACLES[name])
