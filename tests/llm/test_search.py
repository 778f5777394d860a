"""Ranked search, SimHash near-duplicates and spelling variants, against brute force and at the edges."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from docmosaic.llm import ranked, simhash, spelling, tiles
from docmosaic.llm.components import components
from docmosaic.llm.q_search import op12_simhash_near_dedup, op13_spelling_variants
from tests.conftest import DATA


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- ranked search -----------------------------------------------------

TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def brute_ranks(rows, items, k):
    docs = [(i, Counter(re.findall(TERM, low(t)))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in {x for x in items if x[0] is not None}:
        asked.setdefault(item, Counter()).update(re.findall(TERM, low(text)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, times in terms.items() if t in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def zipf(n, seed, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"W{int(vocabulary ** r.random())}" for _ in range(n))


def test_ranks_agree_with_brute_force(spark, docs, monkeypatch):
    rows = [(k, zipf(5 + 7 * k % 60, k)) for k in range(400)]
    rows += [(500 + k, zipf(30, 1)) for k in range(60)]  # copies tie, and the id decides
    rows += [(600, zipf(20_000, 5)), (601, None), (602, ""), (603, "--- \n"), (604, "É é ß ÀÉ w1 a b"), (None, zipf(30, 1))]
    items = [(k, zipf(25, 1000 + k)) for k in range(12)] + [(1, zipf(9, 7)), (20, zipf(30, 1)), (20, zipf(30, 1)), (21, None),
             (22, "nothing like it"), (None, "w1"), (23, "é É w1 w1"), (24, "")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, rank int")
    want = brute_ranks(rows, items, 20)
    for postings in (10**6, 3000):  # one shard, and several
        monkeypatch.setattr(ranked, "POSTINGS", postings)
        found = ranked.LexicalIndex(docs(rows)).search(bench, k=20)
        assert sorted(map(tuple, found.collect())) == want
    assert ranked.LexicalIndex(docs(rows).where("false")).search(bench).count() == 0
    assert ranked.LexicalIndex(docs(rows[:9])).search(bench.where("false")).count() == 0
    named = docs(rows[:40]).selectExpr("concat('n', doc_id) as doc_id", "text", "score", "id as item")
    assert ranked.LexicalIndex(named).search(bench, k=3).where("item = 20").count() == 3


def test_range_maxima_are_exact():
    r = np.random.default_rng(3)
    for n in (1, 15, 16, 17, 40, 333):
        shard = ranked.Shard.__new__(ranked.Shard)
        shard.impact = r.integers(1, 50, n)
        shard._tables()
        lo, hi = np.triu_indices(n + 1)
        got = shard.most(lo.reshape(1, -1), hi.reshape(1, -1))[0]
        for a, b, x in zip(lo, hi, got):
            assert x == -1 if a == b else (x >> 32 == shard.impact[a:b].max() and a <= x & 0xFFFFFFFF < b)


def test_search_leaves_most_documents_unscored(monkeypatch):
    """A few documents hold all terms of a query: the rest is bounded, not scored."""
    texts = [" ".join(dict.fromkeys(low(zipf(40, k)).split())) for k in range(3000)]
    for k in range(5):
        texts[k * 500] = "w1 w2 rare1 rare2 rare3 rare4"
    shard = ranked.Shard(texts, [np.ones(len(t.split()), np.int64) for t in texts], np.full(3000, 100))
    seen, inner = [], ranked.Shard._scored
    monkeypatch.setattr(ranked.Shard, "_scored", lambda self, b, w, lo, hi: seen.append((hi - lo).sum()) or inner(self, b, w, lo, hi))
    docs, _ = shard.search(["w1", "w2", "rare1", "rare2", "rare3", "rare4"], np.array([1, 2, 900, 900, 900, 900]), 5)
    assert docs.tolist() == [0, 500, 1000, 1500, 2000]
    assert sum(seen) < 600


# --- SimHash -----------------------------------------------------------


def brute_print(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", low(text))
    if not words:
        return 0
    width = min(size, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + width]).encode(), 42) for k in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(named, radius):
    """{place in ``named``: smallest id reachable}, over (id, print) rows."""
    prints = sorted({p for i, p in named if i is not None})
    at = {p: p for p in prints}

    def top(p):
        while at[p] != p:
            p = at[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= radius:
                at[top(a)] = top(b)
    least = {}
    for i, p in named:
        if i is not None:
            least[top(p)] = min(least.get(top(p), i), i)
    return [(i, p, least[top(p)] if i is not None else None) for i, p in named]


def test_members_agree_with_brute_force(spark, docs):
    base = zipf(400, 1, 5000).split()
    rows = [(k, zipf(40, k)) for k in range(30)] + [(40, None), (41, ""), (42, " \n"), (43, "one"), (44, "ONE"), (45, "one two"), (46, "é É"),
            (None, zipf(40, 1)), (47, zipf(40, 1)), (47, zipf(40, 2)), (48, zipf(60_000, 9))]
    rows += [(60 + k, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k in range(100)]
    got = sorted(((r.id, r["print"] % 2**64, r.component) for r in simhash.members(docs(rows)).collect()), key=str)
    assert got == sorted(brute_components([(i, brute_print(t)) for i, t in rows], 3), key=str)
    assert simhash.members(docs(rows).where("false")).count() == 0


def test_query_agrees_with_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op12_simhash_near_dedup(spark, str(DATA)).collect())
    assert got == sorted(brute_components([(i, brute_print(t)) for i, t in rows], 3))


@pytest.mark.parametrize("radius", [1, 2, 3, 5, 7])
def test_bit_sliced_distances(radius):
    r = random.Random(radius)
    prints = {r.getrandbits(64) for _ in range(90)} | {0, 2**64 - 1}
    for p in list(prints):
        for k in range(1, radius + 3):
            prints.add(p ^ sum(1 << b for b in r.sample(range(64), k)))
    held = np.array(sorted(prints), np.uint64)
    row, word, hits = simhash.within(held, simhash.planes_of(held), len(held), radius)
    got = {(int(a), int(w) * 64 + b) for a, w, h in zip(row, word, hits) for b in range(64) if int(h) >> b & 1}
    n = range(len(held))
    assert got == {(a, b) for a in n for b in n if (int(held[a]) ^ int(held[b])).bit_count() <= radius}


def test_links_survive_keys_and_blocks(spark):
    """Chains of prints at distance 1 to 3, in one hot key cut into many blocks."""
    r = random.Random(5)
    p, prints = 0, []
    for k in range(300):
        p ^= sum(1 << b for b in r.sample(range(20) if k % 3 else range(64), 1 + k % 3))
        prints.append(p - 2**64 if p >> 63 else p)
    prints += [r.getrandbits(63) for _ in range(100)]
    table = spark.createDataFrame([(k, x) for k, x in enumerate(prints)], "doc_id int, print bigint")
    classes = table.select("print").distinct()
    want = {(i, c) for i, _, c in brute_components([(k, x % 2**64) for k, x in enumerate(prints)], 3)}
    for block in (4096, 16):
        of = {r.node: r.component for r in components(simhash.links(classes, block=block)).collect()}
        least = {}
        for k, x in enumerate(prints):
            least.setdefault(of.get(x, x), k)
        assert {(k, least[of.get(x, x)]) for k, x in enumerate(prints)} == want


def test_tiles_meet_all_pairs_of_a_key(spark):
    rows = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(95)], "key int, v int")
    found = tiles.tiled(rows, ["key"], "v", 8).collect()
    together = {}
    for r in found:
        together.setdefault((r.key, r.i, r.j), set()).add(r.v)
    pairs = {(a, b) for x in together.values() for a in x for b in x if a < b}
    assert pairs == {(a, b) for a in range(90) for b in range(a + 1, 90) if a % 3 == b % 3}
    assert max(map(len, together.values())) <= 34


# --- spelling ----------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts, ratio=5):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts), key=str)


def test_variants_agree_with_brute_force(spark):
    r = random.Random(2)
    words = {"".join(r.choice("abÀé𝒳") for _ in range(r.randrange(1, 9))) for _ in range(500)}
    words |= {"a" * k for k in range(1, 60)} | {"ab" * 20, "ab" * 19 + "a", "x" + "y" * 50_000, "y" * 50_000, "y" * 49_999 + "z"}
    counts = {w: 6 ** r.randrange(6) for w in words}
    table = spark.createDataFrame([(w, n, 1, "x") for w, n in counts.items()] + [(None, 3, 1, "x"), ("", 9, 1, "x")],
                                  "word string, n bigint, longer int, form string")
    want = brute_variants(counts)
    for block in (2048, 20):
        got = spelling.variants(table, block=block).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert sorted(map(tuple, got), key=str) == want
    assert spelling.variants(table.where("false")).count() == 0


def test_word_counts(spark, docs):
    rows = [(1, "Wörter, WÖRTER word's WORD"), (1, "word"), (2, None), (3, ""), (None, "word ÿÿ×"), (4, "a" * 70_000 + " " + "word " * 3)]
    got = dict(map(tuple, spelling.word_counts(docs(rows)).collect()))
    assert got == {"wörter": 1, "wÖrter": 1, "word": 7, "s": 1, "ÿÿ×": 1, "a" * 70_000: 1}
    planted = Counter()
    for i, t in rows:
        for w, n in Counter(re.findall("[a-zÀ-ÿ]+", low(t))).items():
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 3 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            planted[w] += n
    assert dict(map(tuple, spelling.word_counts(docs(rows), one_in=3).collect())) == planted
    assert spelling.word_counts(docs(rows).where("false")).count() == 0


def test_spelling_query_agrees_with_brute_force(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        for w, n in Counter(re.findall("[a-zÀ-ÿ]+", low(r.text))).items():
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += n
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = op13_spelling_variants(spark, str(DATA)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == brute_variants(counts)
