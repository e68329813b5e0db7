"""Small cases of what a review found on larger tables."""

import math
import random
import re
from collections import Counter
from dataclasses import replace
from pathlib import Path

import compare
import duckdb
from pyspark.sql import functions as F

from quarrystone import fixed
from quarrystone.functions import text as T
from quarrystone.operators import cells, chunking, evaluation, graph, router, sessions, sparse, windows
from quarrystone.plans import ORACLES, QUERIES, inputs
from quarrystone.sources import logs


def test_reports_share_files_and_the_newest_come_first(spark, tmp_path):
    path = str(tmp_path / "reports")
    rows = spark.range(500).select("id", F.format_string("eval_%04d", "id").alias("file")).repartition(3)
    logs.write_reports(rows, path)
    assert len(list(Path(path).rglob("*.json"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = logs.read_reports(spark, path, "id bigint", 3).collect()
    assert [(r.id, r.file) for r in got] == [(499, "eval_0499"), (498, "eval_0498"), (497, "eval_0497")]


def test_reports_without_a_name_have_that_of_their_folder(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.json").write_text('{"id": 1}\n')
    got = logs.read_reports(spark, f"{tmp_path}/*", "id bigint").collect()
    assert [r.file for r in got] == ["b", "a"]


def test_cache_finds_the_nearest_entry_whatever_its_text(spark):
    entries = spark.createDataFrame([(1, "a", [1.0, 0.1], 0, "r1"), (2, "b", [1.0, 0.0], 0, "r2")], "entry_id long, query string, embedding array<double>, ts_s long, response string")
    lookups = spark.createDataFrame([(7, "a", [1.0, 0.0]), (8, "c", [1.0, 0.0])], "qid long, query string, embedding array<double>")
    got = {r.qid: (r.outcome, r.entry_id) for r in sessions.semantic_lookup(lookups, entries, F.lit(1)).collect()}
    assert got == {7: ("semantic", 2), 8: ("semantic", 2)}


def test_two_places_round_the_number_itself(spark):
    # 29 / 200 is a little less than 0.145; 0.125 is exact and goes up
    r = spark.range(1).select(T.two_places(F.lit(29) / F.lit(200)).alias("a"), T.two_places(F.lit(0.125)).alias("b")).first()
    assert (r.a, r.b) == ("0.14", "0.13")


def test_rounding_follows_the_number_itself(spark):
    # 0.5242855 * 1e6 is a little less than 524285.5
    assert spark.range(1).select(T.rounded(F.lit(0.5242855), 6).alias("x")).first().x == 0.524285


def test_index_reads_each_block_once_in_whatever_order_it_finds_them(spark, tmp_path, monkeypatch):
    zeros = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(0.0), F.lit(0.0)).alias("embedding"))
    index = cells.build_index(zeros, str(tmp_path / "index"), rows=100)
    found = cells._reads

    def turned(queries, index, first):
        order = F.asc("block") if first else F.desc("block")
        return found(queries, replace(index, blocks=index.blocks.coalesce(1).orderBy(order)), first)

    monkeypatch.setattr(cells, "_reads", turned)
    query = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>")
    hits, visits = cells.search(query, index, 10)
    assert sorted(r.vec_id for r in hits.collect()) == list(range(10))
    assert visits.first().blocks == index.blocks.count()


def test_answer_metrics_split_each_text_once(spark):
    rows = spark.createDataFrame([("A b  c", "a b c d", "a d", ["a b", "x"]), ("", " ", "", [])], "answer string, truth string, query string, contexts array<string>")
    scored = evaluation.harness_score(rows)
    got = [tuple(r) for r in scored.select(*evaluation.METRICS).collect()]
    assert got == [(2 / 3, 0.5, 0.5, 0.5), (0.5, 0.5, 0.0, 0.0)]
    bucket = evaluation.failure_bucket(F.lit(None).cast("string"), F.col("answer"), F.col("overall_score"))
    plan = scored.select(bucket)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 4


def test_trailing_counts_add_up_no_frame_anew(spark):
    times = [0, 0, 5, 9, 10, 14, 15, 19, 20, 29, 30, 47, 1000]
    rows = [(k, u) for k in (1, 2) for u in times[k - 1:]]
    out = windows.trailing_counts(spark.createDataFrame(rows, "tenant_id long, us long"), {"n": 10})
    want = sorted((k, u, sum(u - 10 < v <= u for j, v in rows if j == k)) for k, u in rows)
    assert sorted(tuple(r) for r in out.collect()) == want
    # a frame that slides is summed once more for each row
    frames = out._jdf.queryExecution().optimizedPlan().toString().split("specifiedwindowframe(")[1:]
    assert frames and all("unboundedpreceding" in f.split(")")[0] for f in frames)


def test_folds_share_one_count_of_terms(spark, monkeypatch):
    texts = ["define gross margin", "compare profit with google profit", "analyze risk for tesla last year", "who runs apple", "revenue", "explain falling profit"]
    rows = [(i, f"{texts[i % 6]} {'alpha' if i % 4 else 'beta'} {i % 5}x", "complex" if i % 3 else "simple", i % 2) for i in range(48)]
    split = spark.createDataFrame(rows, "id long, query string, label string, fold int")
    want = {}
    for k in (0, 1):
        model = router.train_router(split.where(F.col("fold") != k), max_iter=15)
        want |= {r.id: (r.predicted, r.confidence) for r in router.router_predict(split.where(F.col("fold") == k), model).collect()}
    # no fold trains on texts of its own
    monkeypatch.setattr(router, "train_router", None)
    got = {r.id: (r.predicted, r.confidence) for r in router.held_out_predictions(split, 2, max_iter=15).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-3 for k in want)
    terms = spark.createDataFrame([(["a", "a", "b"], 0), (["c", "b", "d"], 1), (None, 1), (["d"], 1)], "terms array<string>, fold int")
    assert router.fold_terms(terms, 2, 2) == [["d", "b"], ["a", "b"]]


def test_chunks_are_packed_once(spark):
    docs = spark.createDataFrame([(1, "ITEM 1. A\nOne is here. Two!\n\nThree?"), (2, " \t\x0b")], "doc_id long, text string")
    out = chunking.chunk_parent_child(docs)
    assert [(r.type, r.text) for r in out.collect()] == [("parent", "One is here. Two!\n\nThree?"), ("child", "One is here. Two!\n\nThree?")]
    # one fold for parents, one for children
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2


def test_strip_takes_white_space_only(spark):
    texts = ["", " ", "\t a\x0b b\r\n\x0c", " x ", "a", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.strip(F.col("t")).alias("s"))
    assert [r.s for r in got.collect()] == ["", "", "a\x0b b", " x ", "a", None]


def _kept(spark, text):
    """Kept tokens of a text, stemmed by the column expression."""
    words = [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) > 1 and w not in fixed.STOP_WORDS]
    if not words:
        return []
    stems = {r.w: r.s for r in T.stemmed(spark.createDataFrame([(w,) for w in sorted(set(words))], "w string"), "w", "s").collect()}
    return [stems[w] for w in words]


def test_tokens_are_counted_without_a_row_each(spark, monkeypatch):
    monkeypatch.setattr(sparse, "PIECE_BYTES", 40)
    texts = ["Running runs RUN, the rationally-relational conditionally", None, "", " \n ", "\u00e9ab\u00e9cd \u212aelvin x 1a2", "ab", "cd ab", "glass bus basis class lying sing" * 3, "is the"]
    rows = [*enumerate(texts), (5, "ab run"), (4, None), (None, "alpha"), (None, "alpha beta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter()
    for k, text in rows:
        want.update((k, t) for t in _kept(spark, (text or "").replace("\u212a", "k")))
    size = Counter()
    for (k, _), n in want.items():
        size[k] += n
    got = sparse.postings(docs, parts=2)
    assert {tuple(r) for r in got.collect()} == {(k, t, n, size[k]) for (k, t), n in want.items()} and got.count() == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_search_in_blocks_and_slices_is_plain_bm25(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{chr(97 + i)}{chr(98 + i)}q" for i in range(20)]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 15))) for i in range(150)} | {200 + i: f"{words[0]} {words[1]}" for i in range(30)}
    asked = {q: " ".join(rng.choices(words, k=4)) for q in range(11)} | {50: "unheard", 51: ""}
    tf = {i: Counter(t.split()) for i, t in texts.items()}
    df = Counter(w for c in tf.values() for w in c)
    raw = {w: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    avg = sum(sum(c.values()) for c in tf.values()) / len(texts)
    want = set()
    for q, text in asked.items():
        score = {i: sum(n * idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for w, n in Counter(text.split()).items() if c[w]) for i, c in tf.items()}
        best = sorted((-round(x, 6), i) for i, x in score.items() if round(x, 6) > 0)[:4]
        want |= {(q, i, -x, k) for k, (x, i) in enumerate(best, 1)}
    monkeypatch.setattr(sparse, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(sparse, "SLICE_DOCS", 40)
    index = sparse.build_index(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), buckets=3)
    queries = spark.createDataFrame(list(asked.items()), "qid long, query string")
    hits = sparse.search(queries, index, 4)
    assert {tuple(r) for r in hits.collect()} == want
    # scores are summed in slices, not as a row for each query, document and term
    assert "FlatMapCoGroupsInArrow" in hits._jdf.queryExecution().optimizedPlan().toString()
    bounded, reads = sparse.bounded_search(queries, index, sparse.term_bounds(index), 4)
    assert {tuple(r) for r in bounded.collect()} == want
    total = {q: sum(df[w] for w in set(t.split())) for q, t in asked.items() if any(w in df for w in t.split())}
    assert {r.qid: r.postings + r.skipped for r in reads.collect()} == total
    sparse.drop_index(index)


def test_passages_are_sought_by_hashed_runs(spark):
    texts = ["a b c d e f g h", "b c", "", None, "x a b c d e f g hy", "a  b", "c d e f g", "b b b b b b b"]
    items = ["a b c d e f", "b c d e f g h", "a b c", "b c d e", "a b c d e", "b b b b b b", "b b b", "zz", "", None, "a  b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for chosen in (given, given.where("length(text) - length(replace(text, ' ')) > 1"), given.where("length(text) = 2"), given.where("false")):
        got = evaluation.contained_passages(docs, chosen)
        want = {(i, d) for i, p in chosen.collect() for d, t in enumerate(texts) if p and t and p in t}
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    # the pairs are a written table
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_only_wanted_filings_are_made(spark):
    folder = "/root/testdata/sf0.001"
    every = inputs.filings(spark, folder)
    ids = [r.doc_id for r in every.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(7).collect()] + [10**12]
    only = spark.createDataFrame([(i,) for i in [*ids, ids[0]]], "doc_id long")
    got = inputs.filings(spark, folder, only)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.where(F.col("doc_id").isin(ids)).collect()))


def test_statements_after_long_runs_of_words(spark):
    n = 20_000
    name, words = " ".join(["Word"] * n), " ".join(["word"] * n)
    texts = [name, f"{name} reported $5 million in total revenue", f"{name}'s net income was $3", f"{name} acquired {name}.", f"Cat operates in the {words} industry.", f"{name} B acquired Cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.pos, r.subject, r.predicate, r.object) for r in graph.extract_triples(docs).collect())
    assert got == [(1, 0, name, "REPORTED_REVENUE", "$5 million"), (2, 0, name, "NET_INCOME", "$3"), (3, 0, name, "ACQUIRED", name), (4, 0, "Cat", "OPERATES_IN", words)]


def test_statements_are_those_of_the_patterns(spark):
    rng = random.Random(1)
    parts = ["Foo", "BAR", "B", "iPhone", "x", "the", "in", "total", "reported", "net income was", "revenue", "revenueFoo", "$5", "$.", "million", "acquired", "merged with", "operates in the", "industry", "sectors",
             "software", "'s", "Foos", "Apple's net income was $3 billion", "Foo reported $4 in revenue", "Bar acquired Qux", "Foo operates in the film sector"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", " ", "\n", "  ", "", ". "]) for _ in range(40)) for _ in range(3000)]
    want = []
    for i, text in enumerate(texts):
        found = [(k, m.groups()) for k, _, pattern in fixed.TRIPLE_PATTERNS for m in re.finditer(pattern, text, re.ASCII)]
        want += [(i, pos, g[0], k, g[1] if len(g) == 2 else f"${g[1]} {g[2] or ''}".strip()) for pos, (k, g) in enumerate(found)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {k for _, _, _, k, _ in want} == {k for k, _, _ in fixed.TRIPLE_PATTERNS}
    assert sorted((r.doc_id, r.pos, r.subject, r.predicate, r.object) for r in graph.extract_triples(docs).collect()) == sorted(want)


def _as_by_sql(spark, tmp_path, name):
    """A query's rows and those of its SQL, over a small folder with documents that are runs of thousands of words."""
    given, folder = "/root/testdata/sf0.001", str(tmp_path)
    for t in ("customer", "orders", "nation"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{given}/{t}.parquet")
    long = "Word " * 6000
    docs = spark.read.parquet(f"{given}/documents.parquet").select("doc_id", "text")
    docs.union(spark.createDataFrame([(10**6, long + "acquired Cat"), (10**6 + 1, f"Cat operates in the {long.lower()}industry"), (10**6 + 2, long)], docs.schema)).coalesce(1).write.parquet(f"{folder}/documents")
    next((tmp_path / "documents").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders", "nation", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = QUERIES[name](spark, folder)
    return compare.rows_of(df.columns, df.collect()), compare.oracle_rows(con, ORACLES[name])


def test_graph_tables_of_long_runs_of_words(spark, tmp_path):
    got, want = _as_by_sql(spark, tmp_path, "graph_io")
    assert got == want


def test_graph_size_of_long_runs_of_words(spark, tmp_path):
    got, want = _as_by_sql(spark, tmp_path, "graph_stats")
    assert got == want
