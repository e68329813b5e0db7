"""Streams, logs and caches in time order, and line differences, against plain versions."""

import difflib
import json
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrystone.operators import comparing, fusion, sessions, windows
from quarrystone.session import SETTINGS, fresh_path
from quarrystone.sources import logs
from quarrystone.streaming import jobs


def test_recent_turns_keep_a_bounded_state(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    own.conf.set("spark.sql.session.timeZone", "UTC")
    schema = "conv_id long, ts timestamp, turn long, role string, text string"

    def turns(*rows):
        return own.createDataFrame(rows, "conv_id long, s long, turn long, role string, text string").selectExpr("conv_id", "timestamp_seconds(s) AS ts", "turn", "role", "text")

    base, day = 1_700_000_000, 86_400
    arrivals = [turns(*[(1, base + t, t, "user", f"a{t}") for t in range(25)], (2, base, 0, "user", "b0")), turns(*[(1, base + 100 + t, 25 + t, "bot", f"c{t}") for t in range(4)]),
                turns((3, base + 3 * day, 0, "user", "z")), turns((2, base + 3 * day + 60, 7, "user", "again"))]
    path = fresh_path(own, "turns")
    turns((1, 0, 0, "", "")).limit(0).write.parquet(path)
    rows = []
    stream = jobs.recent_turns(own.readStream.schema(schema).parquet(path))
    out = jobs.drain_arrivals(stream, path, arrivals, "turns", ["conv_id"], lambda q: rows.append(q.lastProgress.stateOperators[0].numRowsTotal))
    got = {r.conv_id: [t.turn for t in r.turns] for r in out.collect()}
    assert got == {1: [24, 25, 26, 27, 28], 2: [7], 3: [0]}  # the second conversation was forgotten in between
    # a list and a time for each conversation; after three days only the third one's are left
    assert max(rows) <= 4 and rows[2] == 2


def test_repeats_are_forgotten_when_their_time_is_over(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    own.conf.set("spark.sql.session.timeZone", "UTC")
    hour = 3_600_000_000

    def rows(*given):
        return own.createDataFrame(given, "k string, us long, event_id long").selectExpr("k", "timestamp_micros(us) AS ts", "us", "event_id")

    # a watermark begins at the epoch
    first = [("a", 10, 1), ("a", hour, 2), ("b", 2 * hour, 3), ("c", 3 * hour, 4)]
    arrivals = [rows(*first), rows(("d", 60 * hour, 5)), rows(("a", 61 * hour, 6), ("d", 62 * hour, 7), ("d", 85 * hour, 8))]
    path = fresh_path(own, "repeats")
    rows(("x", 0, 0)).limit(0).write.parquet(path)
    held = []
    stream = jobs.deduplicated(own.readStream.schema("k string, ts timestamp, us long, event_id long").parquet(path), ["k"])
    out = jobs.drain_arrivals(stream, path, arrivals, "repeats", watch=lambda q: held.append(q.lastProgress.stateOperators[0].numRowsTotal))
    assert sorted(r.event_id for r in out.collect()) == [1, 3, 4, 5, 6, 8]
    assert held[1] < held[0]


def test_log_stops_at_the_first_bad_line_of_each_file(spark, tmp_path):
    rng, want = random.Random(3), []
    for f in range(4):
        bad = {2: 300, 3: 0}.get(f, 10**9)
        lines = []
        for i in range(400):
            if i == bad or i > bad and rng.random() < 0.3:
                lines.append('{"query": "cut')
            elif rng.random() < 0.1:
                lines.append("  ")
            else:
                lines.append(json.dumps({"query": f"q{f}-{i}", "tokens_in": i}))
                if i < bad:
                    want.append((f"q{f}-{i}", i))
        (tmp_path / f"log{f}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = logs.scan_log(spark, str(tmp_path), "cost", "stop")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert sorted((r["query"], r.tokens_in) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_worker_loads_its_scorer_once(spark, tmp_path):
    def load():
        (tmp_path / f"load-{os.getpid()}-{len(list(tmp_path.iterdir()))}").write_text("")

        def score(query, text):
            assert len(query) <= 50
            return (query.str.len() - text.str.len()).abs().astype("float64")

        return score

    rows = spark.range(4000).repartition(16).select((F.col("id") % 40).alias("qid"), F.col("id").alias("pos"), F.lit("abc").alias("query"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("text"))
    scorer = fusion.pair_scorer(load, rows=50)
    for _ in range(2):
        top = fusion.rerank(rows, scorer, 3).collect()
        assert len(top) == 120 and all(r.rerank_score == 5.0 for r in top if r["rank"] == 1)
    loads = [p.name.split("-")[1] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) < 16


def patched(old, diff):
    lines, out, at = old.splitlines(keepends=True), [], 0
    for t in diff:
        if t.startswith("@@"):
            first, n = (t.split()[1][1:].split(",") + ["1"])[:2]
            first = int(first) - (int(n) > 0)
            out += lines[at:first]
            at = first
        elif t[0] in " -":
            assert lines[at] == t[1:]
            at += 1
        if t[0] in " +":
            out.append(t[1:])
    return "".join(out + lines[at:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(0, 3))
def test_differences_lead_from_old_to_new(old, new, context):
    a, b = ("".join(x + "\n" for x in t) for t in (old, new))
    added, removed, hunks, diff = comparing._unified(a, b, context)
    body = diff.splitlines(keepends=True)[2:]
    assert patched(a, body) == b
    assert added - removed == len(new) - len(old)
    assert added + removed <= sum(t[0] in "+-" for t in list(difflib.unified_diff(old, new, n=0))[2:] if not t.startswith("@@")) or hunks


def test_one_inserted_line_is_one_added_line(spark):
    text = "\n".join(f"line {i % 7}" for i in range(100))
    lines = text.split("\n")
    rows = [(1, text, "\n".join(lines[:50] + ["new"] + lines[50:])), (2, text, text), (3, None, "a\nb"), (4, "a", None), (5, None, None), (6, "a\nb\nc\n", "a\nx\nc\n")]
    got = {r.doc_id: r for r in comparing.diff_versions(spark.createDataFrame(rows, "doc_id long, old string, new string")).collect()}
    assert {k: (r.changed, r.added, r.removed, r.hunks) for k, r in got.items()} == {
        1: (True, 1, 0, 1), 2: (False, 0, 0, 0), 3: (True, 2, 0, 1), 4: (True, 0, 1, 1), 5: (False, 0, 0, 0), 6: (True, 1, 1, 1)}
    assert got[6].diff == "".join(difflib.unified_diff(["a\n", "b\n", "c\n"], ["a\n", "x\n", "c\n"], "old", "new"))
    assert got[1].diff.split("\n")[2] == "@@ -48,6 +48,7 @@"


@pytest.mark.parametrize("most,block", [(3, 2), (8, 50)])
def test_lookups_see_the_cache_of_their_own_time(spark, most, block):
    rng, day = random.Random(most), 86_400
    vec = lambda: [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]
    entries = [(i, rng.choice("abcd"), vec(), rng.randrange(3 * day), f"r{i}") for i in range(60)]
    lookups = [(i, rng.choice("abcde"), vec(), rng.choice(entries)[3] if i % 3 else rng.randrange(4 * day)) for i in range(80)]
    want = {}
    for qid, text, v, at in lookups:
        put = sorted((e for e in entries if e[3] < at), key=lambda e: (e[3], e[0]))[-most:]
        seen = [e for e in put if at - e[3] < day]
        cos = [round(float(np.dot(v, e[2]) / (np.linalg.norm(v) * np.linalg.norm(e[2]))), 9) if any(v) and any(e[2]) else 0.0 for e in seen]
        near = max(range(len(seen)), key=lambda k: (cos[k], -k), default=None)
        same = next((e for e in seen if e[1] == text), None)
        if near is not None and cos[near] >= 0.92:
            want[qid] = ("semantic", seen[near][0], len(seen))
        else:
            want[qid] = ("exact", same[0], len(seen)) if same else ("miss", None, len(seen))
    out = sessions.lookup_in_time(spark.createDataFrame(lookups, "qid long, query string, embedding array<double>, ts_s long"),
                                  spark.createDataFrame(entries, "entry_id long, query string, embedding array<double>, ts_s long, response string"), max_entries=most, block=block)
    rows = out.collect()
    assert {r.qid: (r.outcome, r.entry_id, r.n_seen) for r in rows} == want and len(rows) == len(want)
    assert all(r.response == (None if r.entry_id is None else f"r{r.entry_id}") for r in rows)


def test_running_requests(spark):
    rng = random.Random(2)
    rows = [(i % 2, i, rng.randrange(40), rng.randrange(9)) for i in range(60)]
    got = windows.rate_status(spark.createDataFrame(rows, "tenant_id long, event_id long, us long, duration_us long")).collect()
    want = {i: sum(t == u and s <= us < s + d for u, _, s, d in rows) for t, i, us, _ in rows}
    assert {r.event_id: r.concurrent for r in got} == want
