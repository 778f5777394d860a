"""Decontamination, line deduplication and the licence scan, against brute force and at the edges."""

import hashlib
import random
import re

import numpy as np
import pytest

from docmosaic.llm import decontaminate, fingerprint, licenses, lines, ngram_join, quality


def words(n, seed, vocabulary=40):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# --- decontamination ---------------------------------------------------


def brute_windows(text, items, window=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = split(text), set(), set()
    for name, item in items:
        iw = split(item)
        size = min(window, len(iw))
        known = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else set()
        for i in range(len(w) - size + 1):
            if known and tuple(w[i : i + size]) in known:
                hit |= set(range(i, i + size))
                names.add(str(name))
    return len(w), len(hit), sorted(names)


def test_matches_agree_with_brute_force(spark, docs):
    items = [(k, " ".join(words(14, k))) for k in range(6)] + [(6, "short one"), (7, None), (8, ""), (9, " ".join(words(14, 0)))]
    rows = [(k, " ".join(words(30, 100 + k, 5)) + " " + " ".join(words(14, k % 6)[2:13]) + " Short, ONE") for k in range(8)]
    rows += [(50, None), (51, ""), (52, "short"), (53, "éa short-one ß"), (None, items[0][1]), (54, items[0][1] * 3), (54, items[0][1] * 3)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 20, 60):  # one block, and several
        got = decontaminate.matches(docs(rows), bench, block_bytes=block).collect()
        found = sorted((str(r["id"]), r["n_words"], r["n_hit"], sorted({m["item_id"] for m in r["matches"]})) for r in got)
        assert found == sorted((str(i), *brute_windows(t, items)) for i, t in rows)


def test_longest_match_is_one_span(spark, docs):
    item = " ".join(words(25, 3, 10_000))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    row = decontaminate.matches(docs([(1, "x y " + item + " z")]), bench).first()
    assert [(m["item_id"], m["start"], m["length"]) for m in row["matches"]] == [("1", 2, 25)]


def test_removal_keeps_columns_and_clean_rows(spark, docs):
    item = " ".join(words(12, 1, 10_000))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    table = docs([(1, "a " + item), (2, "clean"), (3, None), (None, "clean")])
    kept = decontaminate.remove_contaminated(table, bench)
    assert kept.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "None"]
    assert decontaminate.remove_contaminated(table, bench.where("false")).count() == 4
    assert decontaminate.matches(table.where("false"), bench).count() == 0


# --- lines ------------------------------------------------------------


def brute_lines(rows, min_docs, keep):
    seen = {}
    for k, (i, t) in enumerate(rows):
        for n, x in enumerate((t or "").split("\n")):
            key = lines.key_of(x.encode())
            if key:
                seen.setdefault(key, {}).setdefault(k, n)
    out = []
    for k, (i, t) in enumerate(rows):
        kept = []
        for n, x in enumerate((t or "").split("\n")):
            where = seen.get(lines.key_of(x.encode()), {})
            first = min(where, key=lambda d: (rows[d][0] is not None, rows[d][0] or 0), default=None)
            if len(where) < min_docs or keep == "first" and (k, n) == (first, where[k]):
                kept.append(x)
        out.append((str(i), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("joined", [False, True])
@pytest.mark.parametrize("bits", [1 << 31, 1 << 13])
def test_lines_agree_with_brute_force(docs, keep, joined, bits):
    r = random.Random(5)
    rows = [(k, "\n".join(r.choice(["Same line", " same LINE\t", "", "other", f"own {k}", "ünï", "ÜNï"]) for _ in range(6))) for k in range(12)]
    rows += [(20, None), (21, ""), (None, "Same line\nnull id"), (22, "x" * 100_000 + "\nother")]
    out = lines.dedup_lines(docs(rows), min_docs=3, keep=keep, most_bits=bits, broadcast_keys=0 if joined else 1000)
    assert sorted((str(x["doc_id"]), x["text"]) for x in out.collect()) == brute_lines(rows, 3, keep)
    assert set(out.columns) == {*docs([]).columns, "n_lines", "n_dropped"}


def test_lines_of_an_empty_table(docs):
    assert lines.dedup_lines(docs([])).count() == 0


# --- licences ---------------------------------------------------------


def test_licence_lines_and_wrapped_paragraphs(docs):
    mit = licenses.TEMPLATES["MIT"][1]
    half = len(mit) // 2
    rows = [(1, "text\nreleased under the mit license!\nmore text here"), (2, mit[:half] + "\n" + mit[half:]), (3, None), (4, ""),
            (5, "nothing of the kind"), (6, "All rights reserved.\n\nAll rights reserved."), (None, "All rights reserved."), (7, "!!!\n\n???")]
    got = {(r["id"], r["line"], r["license"]): r["dice"] for r in licenses.scan(docs(rows)).collect()}
    assert got[1, 1, "MIT"] == 1.0 and got[2, -1, "MIT"] > 0.9
    assert {k for k in got if k[0] == 6} == {(6, 0, "proprietary"), (6, 2, "proprietary")}
    assert {k[0] for k in got} == {1, 2, 6, None}
    assert licenses.scan(docs([])).count() == 0


# --- near duplicates ---------------------------------------------------


def brute_components(rows, size, least):
    def sset(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = {i: sset(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i)) for i in sets)


@pytest.mark.parametrize("leaders", [(2, 4), ()])
def test_join_agrees_with_brute_force(spark, docs, monkeypatch, leaders):
    monkeypatch.setattr(ngram_join, "LEADERS", leaders)
    r = random.Random(2)
    base = [words(60, k, 500) for k in range(4)]
    rows = []
    for k in range(36):
        w = list(base[k % 4])
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"n{r.randrange(9)}"
        rows.append((k, " ".join(w)))
    rows += [(40, rows[0][1]), (41, rows[0][1].upper()), (42, None), (43, ""), (44, "two words"), (45, "two  WORDS"), (46, " \n")]
    got = ngram_join.NgramJoin(docs(rows), size=3, least=80).members().collect()
    assert sorted((x["id"], x["n_shingles"], x["component"]) for x in got) == brute_components(rows, 3, 80)


def test_texts_with_few_shingles_in_common_are_not_posted(spark, docs, monkeypatch):
    """Pairs that share a fifth of their words link with nothing; their shingles do not travel. Near copies of other sizes link."""
    written, real = {}, ngram_join.materialize

    def counted(df, label="stage"):
        out = real(df, label)
        written.setdefault(label, out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    rows = []
    for k in range(20):
        for i in (2 * k, 2 * k + 1):
            rows.append((i, " ".join([f"both{k}x{j}" for j in range(12)] + [f"own{i}x{j}" for j in range(48)])))
    ngram_join.NgramJoin(docs(rows), size=3, least=80)
    assert written["shared-postings"] == 0
    base = [f"near{j}" for j in range(60)]
    rows += [(50, " ".join(base)), (51, " ".join(base[:50])), (52, " ".join(base[7:])), (53, " ".join(base[:50]))]
    got = ngram_join.NgramJoin(docs(rows), size=3, least=80).members().collect()
    assert sorted((x["id"], x["n_shingles"], x["component"]) for x in got) == brute_components(rows, 3, 80)


@pytest.mark.parametrize("least", [1, 30, 60, 90, 99, 100])
def test_sizes_that_may_link_are_a_step_apart_at_most(least):
    n = np.arange(1, 3000)
    steps = ngram_join.steps_of(n, least)
    assert (steps[n * least // 100 + (n * least % 100 > 0) - 1] >= steps - 1).all()


@pytest.mark.parametrize("share", [0.0, 0.1, 0.4, 1.0, 1.8])
def test_place_in_the_order_takes_its_share(share):
    levels = np.random.default_rng(3).integers(9, 14, 4096).astype(np.uint8)
    level, below = ngram_join.place(levels, share)
    mass = 2.0 ** (levels / 2)
    assert mass[levels < level].sum() + mass[levels == level].sum() * below / 2.0**64 == pytest.approx(min(share, 1.0) * mass.sum())


@pytest.mark.parametrize("least", [10, 50, 90, 100])
def test_join_at_other_limits_agrees_with_brute_force(spark, docs, least):
    r = random.Random(least)
    rows = [(k, " ".join(f"w{r.randrange(6)}" for _ in range(r.randrange(12)))) for k in range(60)]
    got = ngram_join.NgramJoin(docs(rows), size=2, least=least).members().collect()
    assert sorted((x["id"], x["n_shingles"], x["component"]) for x in got) == brute_components(rows, 2, least)


def test_bitmaps_bound_the_difference_of_sets():
    r = np.random.default_rng(2)
    for n in (1, 30, 700):
        a = r.integers(0, 2**64, n, np.uint64)
        b = np.concatenate([a[: n * 9 // 10], r.integers(0, 2**64, n // 7, np.uint64)])
        differ = len(np.setxor1d(a, b))
        assert sum(int(x).bit_count() for x in (ngram_join.bitmap(a) ^ ngram_join.bitmap(b)).view(np.uint64)) <= differ


def test_inner_names_of_columns_may_be_taken(spark):
    text = "line\n" + " ".join(words(30, 1))
    names = ("__score", "__hit", "__mark", "__gone", "__w", "__h", "__id", "other", "lines", "__part")
    table = spark.createDataFrame([(k, text, *range(len(names))) for k in (1, 2)], "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names))
    bench = spark.createDataFrame([(1, "nothing of it")], "item_id bigint, text string")
    assert ngram_join.keep_one(table).columns == table.columns
    assert decontaminate.remove_contaminated(table, bench).columns == table.columns
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.keep_good(table, quality.train(table, none), least=0.0).columns == table.columns
    printed = fingerprint.with_fingerprint(table, "text", "print")
    assert printed.columns == [*table.columns, "print"] and printed.first()["__w"] == 4
    for keep in ("none", "first"):
        kept = lines.dedup_lines(table, min_docs=2, keep=keep)
        assert set(table.columns) <= set(kept.columns) and [r["__mark"] for r in kept.collect()] == [2, 2]


def test_keep_one_keeps_rows_without_id_and_columns(docs):
    text = " ".join(words(30, 1))
    table = docs([(3, text), (2, text), (2, text), (None, text), (4, "else"), (5, None), (6, None)])
    kept = ngram_join.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == ["2", "4", "5", "6", "None"]
    assert ngram_join.keep_one(docs([])).count() == 0


def test_digests_are_hex_of_joined_items(spark):
    found = spark.createDataFrame([([("10", 0, 1), ("9", 4, 1), ("10", 7, 1)],)], f"m {decontaminate.MATCHES.simpleString()}")
    assert found.select(decontaminate.item_digest(found.m)).first()[0] == hashlib.sha256(b"10,9").hexdigest()


def test_license_words_are_worked_out_once(spark):
    """The plan normalises units in one place."""
    mit = licenses.TEMPLATES["MIT"][0]
    docs = spark.createDataFrame([
        (1, f"intro\n{mit}\n\n{mit} {mit}"), (2, " ".join(f"w{k}" for k in range(5000))), (3, "mit " * 500), (4, None), (5, "--")], "doc_id long, text string")
    found = licenses.scan(docs)
    assert {(r.id, r.line, r.license) for r in found.collect()} == {(1, 1, "MIT"), (1, 3, "MIT"), (1, -1, "MIT")}
    plan = licenses.scan(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(lower(unit") == 1
