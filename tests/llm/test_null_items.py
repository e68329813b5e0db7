"""Benchmark items without an id, and parts that are read one at a time."""

from quarrystone.llm import contamination


def test_item_without_id_hits(spark):
    docs = spark.createDataFrame([(1, "so alpha beta gamma ends"), (2, "nothing here"), (3, "delta epsilon")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, "Alpha beta, gamma"), (None, None), (7, "delta epsilon")], "item_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated, r["items"]) for r in contamination.leak_report(docs, bench).collect()}
    assert got == {1: (3, 0, True, []), 2: (0, 0, False, []), 3: (2, 1, True, ["7"])}
    assert [r.doc_id for r in contamination.drop_leaks(docs, bench).collect()] == [2]


def test_parts_are_given_one_by_one(spark):
    bench = spark.createDataFrame([(k, "word " * 4) for k in range(5)], "item_id bigint, text string")
    parts = contamination.item_parts(bench, 45)
    assert not isinstance(parts, list) and [len(next(parts)), *map(len, parts)] == [2, 2, 1]
    assert list(contamination.item_parts(bench.limit(0), 45)) == [[]]
