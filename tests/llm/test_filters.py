"""Personal data, quality, contamination, lines, mixing and near-duplicates against plain versions."""

import random

import brute
import numpy as np
import pytest
import test_similarity
from pyspark.sql import functions as F

from quarrystone.llm import contamination, lines, mixing, pii, quality, simhash, similar

#: Columns that clash with names the operators use themselves.
CLASH = "row judged fp key leak hit deduped mixed email line_id bits".split()


def clash(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def rows():
    return brute.corpus(7, 200, 90)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clash(spark.createDataFrame(rows, brute.SCHEMA).repartition(4))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def test_near_duplicates(docs, rows, empty):
    brute.same(simhash.near_duplicates(docs), brute.near_duplicates(rows), ["doc_id", "fingerprint", "component_id"])
    assert simhash.near_duplicates(empty).collect() == []


def test_links_are_complete(spark):
    r = random.Random(3)
    fps = {0, 1, 3, 7, 15, (1 << 63), (1 << 64) - 1}
    for _ in range(60):
        x = r.getrandbits(64)
        fps |= {x, x ^ 1 << r.randrange(64), x ^ 1 << r.randrange(64) ^ 1 << r.randrange(64), x ^ 7}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = [(fps.index(e.subject), fps.index(e.object)) for e in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()]
    want = [(a, b) for a in range(len(fps)) for b in range(a) if ((fps[a] ^ fps[b]) & ((1 << 64) - 1)).bit_count() <= 2]
    assert brute.components(len(fps), got) == brute.components(len(fps), want)
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp bigint"), 3)


def test_long_text_fingerprint():
    text = ("Wort fünf " * 300_000 + "end").encode()
    words = text.lower().split()
    assert len(words) * 5 > 1 << 20
    grams = {b" ".join(words[k:k + 3]) for k in range(len(words) - 2)}
    times = brute.Counter(b" ".join(words[k:k + 3]) for k in range(len(words) - 2))
    import xxhash

    total = sum(times.values())
    want = sum(1 << b for b in range(64) if 2 * sum(times[g] * (xxhash.xxh64_intdigest(g, 42) >> b & 1) for g in grams) > total)
    assert simhash.fingerprint(text)[0] & ((1 << 64) - 1) == want


def test_keep_first(docs, rows, empty):
    brute.same(similar.keep_first(docs), brute.keep_first(rows, test_similarity.similar), DOCUMENT)
    assert similar.keep_first(empty).collect() == []


def test_near_copies_are_found(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rows = []
    for i in range(150):
        body = [r.choice(words) for _ in range(300)]
        rows.append((3 * i, " ".join(body), "en", "s", 1))
        for k in (1, 2):
            for _ in range(5):  # five-word similarity of some 0.85
                body[r.randrange(300)] = r.choice(words)
            rows.append((3 * i + k, " ".join(body), "en", "s", 1))
            body = rows[-k][1].split()
    kept = {x.doc_id for x in similar.keep_first(spark.createDataFrame(rows, brute.SCHEMA)).collect()}
    assert set(range(0, 450, 3)) <= kept and len(kept) <= 153


PII = [
    "mail bob@x.org or a.b+c@mail.example.co.uk@z.de, 10.0.0.1 and 300.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 1111 1111 +1 (555) 010-9999 +12 +123456789012345678",
    "é\U0001f600 foo@bar.com\nnext line x@y.z x@y no@ @no .@a.b %@a-.c-d-", "+1+2 3456 7890 1+", "12345678901234567890 4000000000000002 " * 3, "+4 " + " " * 500 + "x",
    "9" * 30000 + " " + "a" * 30000 + " " + "1 " * 20000 + "1.2.3." * 5000 + "a@" * 5000 + "b@c." * 4000,
]


def test_pii(spark):
    r = random.Random(2)
    pieces = ["@", ".", "a", "b1", "+", "1", "22", "255", "256", " ", "-", "4111111111111111", "(", "é", "x@y.de", "\n", "%", "+49 30 1234567", "zed", "quite"]
    rows = [(i, t) for i, t in enumerate([*PII, None, "", "nothing"])]
    rows += [(100 + i, "".join(r.choice(pieces) for _ in range(r.randint(1, 60)))) for i in range(300)]
    rows += [(500 + i, f"Filler{i} words here\nDear professor Quixote{i % 2} write to sancho@mancha.es about windmills soon{i}") for i in range(8)]
    rows += [(600 + i, "words about windmills and a professor") for i in range(3)] + [(None, "ip 1.1.1.1"), (None, "ip 1.1.1.1"), (500, "other +1 555 010 9999 text")]
    docs = clash(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    want = brute.pii(rows)
    assert sum(x[-2] for x in want) > 0
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term", "clean_sha256"]
    brute.same(pii.pii_report(docs), want, columns)
    brute.same(pii.pii_report(docs, disclose=0.4), brute.pii(rows, disclose=0.4), columns)


def test_sanitise(spark, empty):
    common = [(10 + i, "the plain words of the corpus") for i in range(30)]
    rows = [(1, "é write the a@b.cd or +1 555 010 9999 x\n\nplain words, signed Quixote; the quixote of the corpus"), (1, None), (2, "plain")] + common
    docs = clash(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted((r.text or "") for r in pii.sanitise(docs).collect() if r.doc_id < 10)
    # a name that stands nowhere else gives its row's values away, on any line and each time; common words do not
    assert got == ["", "plain", "é  the [EMAIL] or [PHONE] x\n\nplain words,  ; the  of the corpus"]
    soft = sorted((r.text or "") for r in pii.sanitise(docs, remove=2.0).collect() if r.doc_id < 10)
    assert soft[-1] == "é [TERM] the [EMAIL] or [PHONE] x\n\nplain words, [TERM] [TERM]; the [TERM] of the corpus"
    assert pii.sanitise(docs).columns == docs.columns
    assert pii.pii_report(empty).collect() == []


def test_quality(docs, rows, empty):
    columns = ["doc_id", *quality.COUNTS, "base_failed", "kept"]
    brute.same(quality.quality_report(docs), brute.quality(rows), columns)
    brute.same(quality.quality_report(docs, prior=5), brute.quality(rows, prior=5), columns)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(x[-1] for x in brute.quality(rows))
    assert quality.quality_report(empty).collect() == []


def test_junk_goes_and_prose_stays(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(500)]
    prose = [(i, " ".join(r.choice(words) for _ in range(200)), "en", "s", 1) for i in range(100)]
    junk = [(900 + i, " | ".join(r.choice(words) + "###" for _ in range(200)), "en", "s", 1) for i in range(10)]
    kept = {x.doc_id for x in quality.keep_good(spark.createDataFrame(prose + junk, brute.SCHEMA)).collect()}
    assert kept == set(range(100))


def test_repetition_is_judged_by_its_source(spark):
    """Two words in five repeat: an outlier in one source, the rule in the other; the same with lines."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    prose = lambda n: [word() for _ in range(n)]

    def row(i, source, share, twice):
        n = 100 - int(share * 50)
        body = prose(n)
        body += body[:100 - n]
        lines = [" ".join(body[k:k + 10]) for k in range(0, 100, 10)]
        lines += [word()] * twice
        return (i, "\n".join(lines), "en", source, 1)

    clean = [row(i, "clean", 0, 0) for i in range(600)] + [row(900, "clean", 0.4, 0), row(901, "clean", 0, 8)]
    loose = [row(2000 + i, "loose", 0.4 * (i % 4 == 0), 8 * (i % 4 == 1)) for i in range(600)]
    rows = clean + loose
    kept = {x.doc_id for x in quality.keep_good(spark.createDataFrame(rows, brute.SCHEMA)).collect()}
    assert kept == {x[0] for x in rows} - {900, 901}


def test_leaks(spark, docs, rows, empty):
    split = [(r[1] or "").split() for r in rows]
    items = [(7, " ".join(split[1][5:30])), (8, "!! " + " , ".join(split[2][3:13]).upper()), (9, " ".join(split[3][:4])), (10, " ".join(split[3][:4])), (11, None), (12, " -- "), (None, "x y"), (13, "nowhere to be found in any of these texts at all")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute.leaks(rows, items)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sum(x[-1] for x in want) > 3
    brute.same(contamination.leak_report(docs, bench), want, columns)
    brute.same(contamination.leak_report(docs, bench, part_bytes=60), want, columns)
    left = contamination.drop_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not x[-1] for x in want)
    assert contamination.leak_report(empty, bench).collect() == []
    assert contamination.drop_leaks(docs, bench.limit(0)).count() == len(rows)


def test_leak_offsets_are_in_the_original(spark):
    docs = spark.createDataFrame([(1, "É... Alpha,  BETA-gamma end")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    found = contamination.find_leaks(docs, bench).first().leak
    assert [docs.first().text.encode()[s.start:s.end].decode() for s in found.spans] == ["Alpha", "BETA", "gamma"]


def own(seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("klmnopqrst") for _ in range(6)) for _ in range(30))


LINES = [(2000 + i, f"{own(i)}\nOrder 77{i} was shipped on 2024-0{i}-01 to you\n{own(50 + i)}\nThanks for reading this page, dear {n} !\n{n} says so", "en", "s", 1)
         for i, n in enumerate(["Ann", "Bob", "Cy", "Dee", "Eve", "Flo"])]


@pytest.mark.parametrize("extra", [LINES, []])
def test_lines(spark, rows, extra):
    given = rows + extra
    docs = clash(spark.createDataFrame(given, brute.SCHEMA).repartition(4))
    want = brute.drop_lines(given)
    got = lines.dedup_lines(docs)
    out = got.columns[-1]
    brute.same(got.select("doc_id", f"{out}.n_lines", f"{out}.n_dropped", f"{out}.text"), want, ["doc_id", "n_lines", "n_dropped", "text"])
    if extra:
        assert sum(x[2] for x in want) > 6
    left = lines.drop_lines(docs)
    assert left.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in left.collect() if r.text is not None and r.n_chars and r.doc_id is not None and len(r.text) > 200 and r.n_chars > 200)


def test_first_copy_keeps_its_lines(spark, empty):
    rows = [(i, f"The very same text\nin all of its many lines\nup to the end {'' if i < 5 else 'xx'}", "en", "s", 1) for i in range(9)]
    rows += [(20 + i, f"My own words are these {i}x{i}\nand for user {'abcdefg'[i]} of this very wide web site here", "en", "s", 1) for i in range(4)]
    rows += [(30, "Something else\nand for user a of this very wide web site here", "en", "s", 1)]
    got = {r.doc_id: r.n_dropped for r in lines.line_report(spark.createDataFrame(rows, brute.SCHEMA)).collect()}
    # the least id keeps each line, and the line that ends otherwise from 5 on stands there first
    assert got == {0: 0, 1: 3, 2: 3, 3: 3, 4: 3, 5: 0 + 2, 6: 3, 7: 3, 8: 3, 20: 0, 21: 2, 22: 2, 23: 2, 30: 1}
    assert lines.line_report(empty).collect() == []


def test_mixing(docs, rows, empty):
    want, t, period = brute.mix(rows)
    brute.same(mixing.mix_report(docs), want, ["doc_id", "source", "block", "slot", "release", "due", "place"])
    assert mixing.mix_report(empty).collect() == []
    small, t, period = brute.mix(rows, block_docs=1, resolution=50)
    got = mixing.mix_report(docs, block_docs=1, resolution=50)
    brute.same(got, small, ["doc_id", "source", "block", "slot", "release", "due", "place"])
    # less than one block from the target at every slot until the first source ends
    ends = min(max(r[3] for r in small if r[1] == s) for s in t)
    for slot in range(ends):
        for s, x in t.items():
            assert abs(sum(r[3] <= slot for r in small if r[1] == s) - (slot + 1) * x / period) < 1


def test_given_weights(spark, docs):
    weights = spark.createDataFrame([("s0", 3.0), ("s1", 1.0), ("other", 5.0)], "source string, weight double")
    got = mixing.mix_report(docs, weights=weights, block_docs=1, resolution=8).where("slot < 8").groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {"s0": 6, "s1": 2, None: 1} or sum(r["count"] for r in got) == 8
