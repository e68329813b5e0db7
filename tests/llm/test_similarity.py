"""The near-duplicate stage against five-word similarity by brute force."""

import random

import brute
import pytest

from quarrystone.llm import similar as stage


def grams(text):
    w = (text or "").lower().encode().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    a, b = grams(a), grams(b)
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.fixture(scope="module")
def words():
    r = random.Random(6)
    return ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]


def block_edits(words, n=40):
    """Texts with a block replaced, appended or cut off, on both sides of similarity 0.8."""
    r, rows = random.Random(8), []
    for i in range(n):
        body = [r.choice(words) for _ in range(300)]
        size = r.randint(24, 42)
        at = r.randrange(300 - size)
        block = [r.choice(words) for _ in range(2 * size)]
        other = {0: body[:at] + block[:size] + body[at + size:], 1: body + block, 2: body[:-2 * size], 3: body[:at] + body[at + size:]}[i % 4]
        rows += [(2 * i, " ".join(body), "en", "s", 1), (2 * i + 1, " ".join(other), "en", "s", 1)]
    return rows


def test_block_edits_link_from_the_threshold(spark, words):
    rows = block_edits(words, 80)
    near = [similar(rows[k][1], rows[k + 1][1]) for k in range(0, len(rows), 2)]
    assert 20 < sum(near) < 60
    kept = stage.keep_first(spark.createDataFrame(rows, brute.SCHEMA))
    brute.same(kept, brute.keep_first(rows, similar), ["doc_id", "text", "lang", "source", "n_chars"])


def test_common_shingles_change_no_result(spark, words, monkeypatch):
    r = random.Random(4)
    shared = [" ".join(r.choice(words) for _ in range(60)) for _ in range(3)]
    rows = [(i, f"{t} {r.choice(shared)}", *x) for i, t, *x in block_edits(words)]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    want = brute.keep_first(rows, similar)
    for common in (1, 1000):
        monkeypatch.setattr(stage, "SAMPLE", 1)
        monkeypatch.setattr(stage, "COMMON", common)
        brute.same(stage.keep_first(docs), want, ["doc_id", "text", "lang", "source", "n_chars"])


def star(words, members):
    """A text and versions of it that are similar to it, but hardly to each other."""
    r = random.Random(2)
    hub = [r.choice(words) for _ in range(300)]
    rows = [(0, " ".join(hub), "en", "s", 1)]
    for i in range(1, members):
        at = r.randrange(270)
        rows.append((i, " ".join(hub[:at] + [r.choice(words) for _ in range(28)] + hub[at + 28:]), "en", "s", 1))
    return rows


def test_no_member_of_a_large_group_is_missed(spark, words):
    rows = star(words, 200)
    assert all(similar(rows[0][1], x[1]) for x in rows[1:])
    lone = rows[50][1].split()
    lone = " ".join(lone[:200] + [lone[k][::-1] for k in range(200, 226)] + lone[226:])
    rows.append((900, lone, "en", "s", 1))
    kept = stage.keep_first(spark.createDataFrame(rows, brute.SCHEMA))
    brute.same(kept, brute.keep_first(rows, similar), ["doc_id", "text", "lang", "source", "n_chars"])


def test_pieces_of_a_bucket_meet(spark, words):
    """Two groups that share buckets; only their last members are similar, so neighbours in order of names need not be."""
    r = random.Random(12)
    base = [r.choice(words) for _ in range(300)]
    chain = [list(base)]
    for _ in range(30):
        body = list(chain[-1])
        at = r.randrange(285)
        body[at:at + 12] = [r.choice(words) for _ in range(12)]
        chain.append(body)
    rows = [(i, " ".join(b), "en", "s", 1) for i, b in enumerate(chain)]
    kept = stage.keep_first(spark.createDataFrame(rows, brute.SCHEMA))
    brute.same(kept, brute.keep_first(rows, similar), ["doc_id", "text", "lang", "source", "n_chars"])


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_a_full_filter_changes_no_result(spark, words, monkeypatch, bits):
    monkeypatch.setattr(stage, "FILTER_BITS", bits)
    rows = block_edits(words) + [(None, "a b", "en", "s", 1), (500, "a b", "en", "s", 1), (500, "a b", "en", "s", 1), (501, None, "en", "s", 1), (502, " ", "en", "s", 1)]
    kept = stage.keep_first(spark.createDataFrame(rows, brute.SCHEMA))
    brute.same(kept, brute.keep_first(rows, similar), ["doc_id", "text", "lang", "source", "n_chars"])


def test_fingerprints_come_first_and_are_verified(spark, words, monkeypatch):
    """Pairs of linked fingerprints are compared before any bucket; what they have connected is not compared again."""
    seen, checked = [], stage.verified

    def spy(pairs, sets):
        seen.append(pairs.count())
        return checked(pairs, sets)

    monkeypatch.setattr(stage, "verified", spy)
    r = random.Random(3)
    body = [r.choice(words) for _ in range(400)]
    rows = [(1, " ".join(body), "en", "s", 1), (2, " ".join([*body, words[0]]), "en", "s", 1), (3, " ".join(r.choice(words) for _ in range(90)), "en", "s", 1)]
    assert bin(stage.fingerprint(rows[0][1].encode())[0] ^ stage.fingerprint(rows[1][1].encode())[0]).count("1") <= 2
    kept = stage.keep_first(spark.createDataFrame(rows, brute.SCHEMA))
    brute.same(kept, brute.keep_first(rows, similar), ["doc_id", "text", "lang", "source", "n_chars"])
    assert seen[0] == 1 and not any(seen[1:])


def test_linked_fingerprints_of_other_texts_link_nothing(spark, words, monkeypatch):
    monkeypatch.setattr(stage, "fingerprint", lambda text: (5,))
    rows = block_edits(words)
    kept = stage.keep_first(spark.createDataFrame(rows, brute.SCHEMA))
    brute.same(kept, brute.keep_first(rows, similar), ["doc_id", "text", "lang", "source", "n_chars"])


def test_components_are_sought_once_and_then_joined(spark, words, monkeypatch):
    """Each search for components is many jobs that the driver plans: what is closed needs none, what is added only its own."""
    sought, found = [], stage.components

    def spy(links):
        sought.append(links.count())
        return found(links)

    monkeypatch.setattr(stage, "components", spy)
    rows = [(1, " ".join(words[:9]), "en", "s", 1), (2, " ".join(words[:9]) + " .", "en", "s", 1), (3, "a b", "en", "s", 1)]
    kept = stage.keep_first(spark.createDataFrame(rows, brute.SCHEMA))
    brute.same(kept, brute.keep_first(rows, similar), ["doc_id", "text", "lang", "source", "n_chars"])
    assert len(sought) == 1
    own = stage.Scratch(spark, "test")
    parts = spark.createDataFrame([(1, 1), (4, 1), (5, 5), (6, 5), (20, 20), (21, 20)], "fp long, component long")
    links = spark.createDataFrame([(4, 6), (2, 5), (8, 9), (1, 4)], "subject long, object long")
    got = {r.fp: r.component for r in stage.joined_parts(parts, links, own).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 5: 1, 6: 1, 8: 8, 9: 8, 20: 20, 21: 20}
    assert sought[1] == 3
