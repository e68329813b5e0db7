"""Plain versions of the operators and the corpora they are compared on."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def corpus(seed: int = 1, vocabulary: int = 60, docs: int = 60) -> list[tuple]:
    """Prose of few words with copies, near copies, shared passages, inner repeats and odd rows."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(vocabulary)]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    passages = [prose(n) for n in (49, 50, 51, 75, 130)]
    rows = []
    for i in range(docs):
        body = prose(r.randint(0, 250))
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(body))
            body[at:at] = r.choice(passages)
        if i % 7 == 3 and rows:
            body = (r.choice(rows)[1] or "").split()
            for _ in range(r.randint(0, 2)):
                if body:
                    body[r.randrange(len(body))] = r.choice(words)
        if i % 11 == 5:
            body = body + prose(5) + body
        text = " ".join(w + ("\n" if r.random() < 0.05 else "") for w in body)
        rows.append((i * 3 % 997, text, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None]), len(text)))
    odd = [None, "", " \n\t", "x", "a" * 700, "ab" * 400, "word " * 130, "    é\r\nz", rows[0][1], rows[0][1]]
    rows += [(1000 + i, t, "en", "s1", len(t or "")) for i, t in enumerate(odd)]
    rows += [(None, rows[1][1], None, None, None), (None, rows[2][1] + " tail", "en", None, 5), rows[4], rows[4], (5, None, None, None, None)]
    return rows


def words_of(text):
    return (text or "").encode().split()


def dedup_substrings(rows, window=50):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - window + 1 if i is not None else 0):
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = True
        out.append((i, len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone) if not g)), spans(gone)))
    return out


def spans(gone):
    return int(np.count_nonzero(np.diff(gone, prepend=False) & gone))


def dedup_bytes(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(t[k:k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = True
        out.append((i, len(t), int(gone.sum()), spans(gone), sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def same(df, want, columns):
    got = [tuple(r) for r in df.select(*columns).collect()]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


# near-duplicates


def print64(text, shingle=3):
    import xxhash

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(n, links):
    head = list(range(n))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def least_id(rows, links):
    comp, least = components(len(rows), links), {}
    for (i, *_), c in zip(rows, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return comp, [least.get(c) for c in comp]


def near_duplicates(rows):
    fps = [print64(t) for _, t, *_ in rows]
    close = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    return [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, least_id(rows, close)[1])]


def keep_first(rows, distance):
    close = [(a, b) for a in range(len(rows)) for b in range(a) if distance(rows[a][1], rows[b][1])]
    comp, _ = least_id(rows, close)
    best = {}
    for r, c in zip(rows, comp):
        rank = (r[0] is None, r[0] or 0)
        if c not in best or rank < best[c][0]:
            best[c] = (rank, r)
    return [r for _, r in best.values()]


# personal data

import math  # noqa: E402
import re  # noqa: E402

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end(), m[0]) for k, p in BASE.items() for m in re.finditer(p, text or "") if fits(k, m[0])]


def terms_in(text):
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", text)]


def pii(rows, disclose=0.8, remove=0.95):
    found = [base_spans(t) for _, t, *_ in rows]
    terms = [terms_in(t or "") for _, t, *_ in rows]
    holds = [{(k, v) for k, _, _, v in f} | {(k, None) for k, *_ in f} for f in found]
    entity = Counter(e for h in holds for e in h)
    term = Counter(w for ts in terms for w in {w for _, _, w in ts})
    both = Counter((e, w) for h, ts in zip(holds, terms) for w in {w for _, _, w in ts} for e in h)
    n = len(rows)
    strength = {}
    for (e, w), k in both.items():
        content = math.log(n / entity[e])
        if content > 0 and (s := math.log(k * n / (term[w] * entity[e]))) >= disclose * content:
            strength[e, w] = s / content
    out = []
    for (i, t, *_), f, ts, h in zip(rows, found, terms, holds):
        plain = [f"{k}:{s}:{e}" for k, s, e, _ in f]
        told = [(x, y, max(strength[e, w] for e in h if (e, w) in strength)) for x, y, w in ts
                if any((e, w) in strength for e in h) and not any(p < y and x < q for _, p, q, _ in f)]
        cuts = sorted([(s, -e, f"[{k.upper()}]") for k, s, e, _ in f] + [(x, -y, "" if z >= remove else "[TERM]") for x, y, z in told])
        at, clean = 0, ""
        for s, e, by in cuts:
            if s >= at:
                clean, at = clean + t[at:s] + by, -e
        out.append((i, *[sum(k == kind for kind, *_ in f) for k in BASE], sha(",".join(plain).encode()),
                    ",".join(plain + [f"term:{x}:{y}" for x, y, _ in told]), len(told), sha((clean + (t or "")[at:]).encode())))
    return out


# quality


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


#: inner and outer quantile, width, slack, and whether there is a lower fence
FENCES = {"word_length": (0.25, 0.75, 3, 0.75, True), "symbols": (0.25, 0.75, 3, 0.05, False), "dup_lines": (0.5, 0.99, 1, 0.02, False), "repeats": (0.5, 0.99, 1, 0.02, False)}


def quality(rows, prior=200):
    every = [counts(r[1]) for r in rows]
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in every]
    n_lines = [sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (r[1] or "").split("\n")) for r in rows]
    ratio = [{"word_length": c[1] / max(c[0], 1), "symbols": c[2] / max(c[0], 1), "dup_lines": c[3] / max(n, 1), "repeats": c[4] / max(c[0], 1)} for c, n in zip(every, n_lines)]
    gamma = 1.01 / 0.99
    bucket = lambda x: math.ceil(math.log(x) / math.log(gamma)) if x > 0 else -1_000_000

    def at(xs, q):
        b = sorted(map(bucket, xs))[math.ceil(len(xs) * q) - 1]
        return 0.0 if b == -1_000_000 else 2 * gamma**b / (gamma + 1)

    out = []
    for r, c, bad, mine in zip(rows, every, failed, ratio):
        kept = not bad
        for name, (inner, outer, width, slack, low) in FENCES.items():
            group = [x[name] for x, o, f in zip(ratio, rows, failed) if not f and o[2] == r[2] and o[3] == r[3]]
            if not group:
                continue
            wide = [x[name] for x, o, f in zip(ratio, rows, failed) if not f and o[2] == r[2]]
            a, b = ((len(group) * at(group, q) + prior * at(wide, q)) / (len(group) + prior) for q in (inner, outer))
            reach = width * (b - a) + slack
            kept &= mine[name] <= b + reach and (not low or mine[name] >= a - reach)
        out.append((r[0], *c, bad, kept))
    return out


# contamination


def leaks(rows, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = [(None if i is None else str(i), tuple(w[k:k + size])) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - size + 1))]
    out = []
    for i, t, *_ in rows:
        w = split(t)
        hit, ids = set(), set()
        for who, g in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    ids |= {who} - {None}
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit)))
    return out


# lines


def tokens(line):
    return ["<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line)]


def drop_lines(rows, depth=3, min_docs=3, share=0.8, least=1):
    docs_of = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n") if i is not None else ():
            if len(k := tuple(tokens(line))) >= least:
                docs_of.setdefault(k, set()).add(i)
    leaves = {}
    for k, d in docs_of.items():
        leaves.setdefault((len(k), k[:depth]), []).append((k, len(d)))
    keeper = {k: min(d) for k, d in docs_of.items() if len(d) >= min_docs}
    for members in leaves.values():
        if sum(n for _, n in members) >= min_docs:
            cells = Counter()
            for k, n in members:
                for cell in enumerate(k):
                    cells[cell] += n
            shapes = {}
            for k, n in members:
                shape = tuple(w if cells[c] >= min_docs else None for c in enumerate(k) for w in [c[1]])
                if n < min_docs and sum(w is not None for w in shape) >= share * len(k):
                    shapes.setdefault(shape, []).append(k)
            for alike in shapes.values():
                keeper |= dict.fromkeys(alike, min(min(docs_of[k]) for k in alike))
    out = []
    for i, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        gone = [i is not None and keeper.get(tuple(tokens(x)), i) != i for x in lines]
        out.append((i, len(lines), sum(gone), t if t is None else "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


# mixing


def mix(rows, block_docs=32, resolution=1000):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, s or ""))
    n = Counter(r[3] for r in rows)
    total = sum(math.sqrt(x) for x in n.values())
    t = {s: max(1, math.floor(resolution * math.sqrt(n[s]) / total + 0.5)) for s in sources}
    period = sum(t.values())
    done, slots = Counter(), {s: [] for s in sources}
    for slot in range(period):
        ready = [(-(-(done[s] + 1) * period // t[s]), k, s) for k, s in enumerate(sources) if done[s] * period // t[s] <= slot]
        s = min(ready)[2]
        slots[s].append(slot)
        done[s] += 1
    out = []
    for s in sources:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(str(r[0] if r[0] is not None else "").encode()).hexdigest())
        for k, r in enumerate(mine):
            b = k // block_docs
            slot = b // t[s] * period + slots[s][b % t[s]]
            out.append((r[0], s, b, slot, b * period // t[s], -(-(b + 1) * period // t[s]), slot * block_docs + k % block_docs))
    return out, t, period
