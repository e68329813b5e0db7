import hashlib
import random
import re
import zlib
from collections import defaultdict

from quarrystone.llm import trie

FOLDER = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Nodes of rows ``conv_id, turn, role, text``, by a dictionary of prefixes; equal turns must not differ."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for seq in members:
        if seq:
            children[seq[:-1]] += 1
    for seq, m in members.items():
        saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        for d in range(len(seq) + 1):
            below[seq[:d]][0] += children[seq] == 0
            below[seq[:d]][1] += saved
    return sorted((m[0], len(seq), members[seq[:-1]][0] if seq else -1, len(m), children[seq], *below[seq],
                   hashlib.sha256(",".join(map(str, ends.get(seq, []))).encode()).hexdigest()) for seq, m in members.items())


def rows_of(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.select(*COLUMNS).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, part long, depth string")


def test_whole_table(spark):
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    want = plain([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(trie.prefix_trie(turns)) == want


def test_components_are_split_by_joins(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 2)
    local, rng = 12, random.Random(3)
    rows = []
    for c in range(45):
        n = rng.choice([0, 1, 2, 3, 6, 30 if c == 21 else 4])
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["a b", "c"])) for t in range(n)]
    assert rows_of(trie.prefix_trie(frame(spark, rows), local)) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a\tb  c"), (1, 0, "user", "a\tb  c"), (2, 5, "user", "long " * 5000), (None, 1, "user", "x"), (20, 0, "", ""), (21, 0, "user", "z"),
            (40, 1, "u", "y"), (45, 1, "u", "y"), (41, 1, "u", "y"), (60, None, "u", "y"), (61, 1, "u", "y")]
    assert rows_of(trie.prefix_trie(frame(spark, rows))) == plain(rows)
    assert trie.prefix_trie(frame(spark, rows).limit(0)).collect() == []


def test_one_long_conversation_lies_in_many_parts(spark):
    rows = [(0, t, "user", f"w{t % 7}") for t in range(3000)] + [(c, t, "user", f"w{t % 7}") for c in (3, 5) for t in range(10 + c)]
    turns = frame(spark, rows).repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie.ranked_turns(turns).select("part").distinct().count() > 4
        assert rows_of(trie.prefix_trie(turns, 500)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_roll_up_of_random_forests():
    rng = random.Random(5)
    for n in (1, 2, 3, 10, 60, 300):
        parent = [rng.randrange(-1, i) if i else -1 for i in range(n)]
        own = [[rng.randrange(9) for _ in range(n)], [1] * n]
        total = [list(x) for x in own]
        trie.roll_up(parent, own, total)
        want = [list(x) for x in own]
        for v in reversed(range(n)):
            if parent[v] >= 0:
                for w in want:
                    w[parent[v]] += w[v]
        assert total == want
