"""Pieces, chat formatting and language-model scores, against brute force and at the edges."""

import itertools
import math
import random
import re
import sys
import weakref
from collections import Counter, defaultdict

import numpy as np
import pytest

from docmosaic.llm import chat, kneser_ney, pieces
from docmosaic.llm.common import in_pieces

TEXTS = ["Hello wörld\n\n a ", "", " ", "a", "banana banana", "▁z ▁", "日本語 テスト", "x" * 3000, "tab\tnul\x00 end", "  two  spaces  "]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


def paths(word, v):
    """All segmentations of a word with the product of their probabilities."""
    lattice = pieces.Lattice([word], v)
    ends = [(0, (), 1.0)]
    while any(at < len(word) for at, *_ in ends):
        ends = [(at, p, w) for at, p, w in ends if at == len(word)] + [
            (at + int(lattice.len[e]), (*p, *lattice.ids[lattice.id_at[e] : lattice.id_at[e] + lattice.id_n[e]].tolist()), w * lattice.q[e])
            for at, p, w in ends if at < len(word) for e in range(lattice.off[at], lattice.off[at + 1])]
    return {p: w for _, p, w in ends}


def test_lattice_probabilities_are_those_of_the_pieces(vocabulary):
    found = paths(" banana", vocabulary)
    assert sum(found.values()) == pytest.approx(1)
    of = {vocabulary.ids[k]: vocabulary.log_p[k] for k in range(len(vocabulary.ids))}
    raw = {p: math.exp(sum(of[i] for i in p)) for p in found}
    total = sum(raw.values())
    assert all(found[p] == pytest.approx(raw[p] / total) for p in found)


def test_samples_follow_the_distribution_without_replacement(vocabulary):
    exact = paths(" banana", vocabulary)
    first, both, weighed = Counter(), Counter(), defaultdict(float)
    runs = 3000
    for key in range(runs):
        rows = list(pieces.encode([b"banana"], [key], vocabulary, 2))
        assert len({tuple(r[2].tolist()) for r in rows}) == 2
        for r in rows:
            path = tuple(r[2].tolist())
            first[path] += r[1] == 0
            both[path] += 1
            weighed[path] += math.exp(r[3]) / r[5] / runs
    top = sorted(exact, key=exact.get)[-3:]
    for p in top:
        assert first[p] / runs == pytest.approx(exact[p], abs=0.03)
    # second draws: the first path taken out, the rest renewed
    for p in top[-2:]:
        second = sum(exact[q] * exact[p] / (1 - exact[q]) for q in exact if q != p)
        assert (both[p] - first[p]) / runs == pytest.approx(second, abs=0.03)
    # weights over inclusion scores estimate the whole mass
    assert sum(weighed.values()) == pytest.approx(1, abs=0.05)


def test_samples_do_not_depend_on_the_batch(vocabulary):
    texts = [t.encode() for t in TEXTS]
    whole = [(r, s, ids.tolist(), round(lp, 9)) for r, s, ids, lp, *_ in pieces.encode(texts, list(range(len(texts))), vocabulary, 3)]
    alone = [(k, s, ids.tolist(), round(lp, 9)) for k, t in enumerate(texts) for _, s, ids, lp, *_ in pieces.encode([t], [k], vocabulary, 3)]
    assert whole == alone


def test_one_block_is_in_memory_at_a_time(vocabulary, monkeypatch):
    alive, before = weakref.WeakSet(), []

    class Counted(pieces.Lattice):
        def __init__(self, *args):
            before.append(len(alive))
            super().__init__(*args)
            alive.add(self)

    monkeypatch.setattr(pieces, "Lattice", Counted)
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 40)
    texts = [b"some words of a text", b"and others", b"", b"the last of these texts"] * 3
    assert {r[0] for r in pieces.encode(texts, list(range(12)), vocabulary)} == set(range(12))
    assert before == [0] * len(before) and len(before) > 3


def test_words_are_found_and_numbered_without_a_python_call_each(vocabulary):
    texts = [t.encode() for t in (*TEXTS, "a  b   c ", "   ", "a b", "\u3000 \u00a0x")]
    for prefix in ("", " "):
        words, number, first = pieces._words(texts, prefix.encode())
        each = [re.findall(" *[^ ]+| +", prefix + t.decode()) if t else [] for t in texts]
        assert words == list(dict.fromkeys(itertools.chain(*each)))
        assert [[words[n] for n in number[a:b]] for a, b in itertools.pairwise(first)] == each

    def calls(words):
        text, n = " ".join(f"{i:04}" for i in range(words)).encode(), 0

        def seen(frame, event, arg):
            nonlocal n
            n += event == "call" and frame.f_code.co_filename == pieces.__file__

        sys.setprofile(seen)
        try:
            list(pieces.encode([text], [1], vocabulary))
        finally:
            sys.setprofile(None)
        return n

    assert calls(4000) < calls(400) + 400


def test_round_trip_and_edges(spark, docs):
    rows = [*enumerate(TEXTS), (None, "null id"), (90, None), (0, TEXTS[0])]
    out = pieces.sample_pieces(docs(rows), samples=3).cache()
    got = out.collect()
    assert all(r["exact"] and 0 < r["inclusion"] <= 1 for r in got)
    assert {r["id"] for r in got} == {i for i, _ in rows}
    assert [len(r["ids"]) for r in got if r["id"] == 90] == [0]
    texts = dict(rows)
    back = pieces.decode_pieces(out).collect()
    assert all(r["text"] == (texts[r["id"]] or "") for r in back)
    assert pieces.sample_pieces(docs([])).count() == 0


# --- chat -------------------------------------------------------------


def test_escapes_undo_exactly():
    t = chat.Template()
    r = random.Random(1)
    pool = [*t.all, "\\", "<", "|", "s>", "/INST]", "[", "ü", "\n", ""]
    for _ in range(2000):
        text = "".join(r.choice(pool) for _ in range(r.randrange(8)))
        inside = t.escaped(text)
        assert not any(c in inside for c in t.all)
        assert t.unescaped(inside) == text
        parts, spans = t.render([("user", text), (text, text)])
        rendered = "".join(parts)
        assert t.parse(rendered) == [("user", text), (text, text)]
        assert [t.unescaped(rendered[a:b]) for a, b in spans] == [text, text]


def test_runs_of_turns_give_the_tokens_of_the_whole(spark):
    from tokenizers import Tokenizer

    t = chat.Template()
    encoder = Tokenizer.from_str(chat._tokenizer(chat.TOKENIZER, t))
    r = random.Random(6)
    talk = [(r.choice(["user", "assistant"]), " ".join(r.choice(["ok", "é", "\U0001F600", "don't", "\n", "<s>"]) for _ in range(r.randrange(12)))) for _ in range(60)]
    parts, spans = t.render(talk)
    whole = encoder.encode("".join(parts), add_special_tokens=False)
    for most in (1, 50, 10**6):
        ids, offsets = chat.encoded(encoder, parts, most)
        assert ids.tolist() == whole.ids and [tuple(x) for x in offsets.tolist()] == whole.offsets
    mask = chat.masked(offsets[:, 0], offsets[:, 1], [s for s in spans if s[0] < s[1]])
    want = [any(a <= x and y <= b for a, b in spans if a < b) for x, y in whole.offsets]
    assert mask.tolist() == want
    assert "".join(chat.covered("".join(parts), offsets[:, 0], offsets[:, 1], mask)) == "".join(t.escaped(x) for _, x in talk)
    assert chat.encoded(encoder, [])[0].tolist() == []


def test_templates_that_cannot_be_undone_are_refused():
    for bad in ("x", "a\\b", "<|tu", "|><|turn"):
        with pytest.raises(ValueError):
            chat.Template(controls=(bad,))


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "é\U0001F600 ok\n"), (1, 0, "user", "</s>[INST]"), (1, 2, "assistant", ""), (2, None, None, None),
            (3, 0, "assistant", "<|done|><|turn|>"), (3, 0, "assistant", "<|done|><|turn|>"), (None, 5, "assistant", "x"), (4, 0, "user", "long " * 20000)]
    talks = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    made = chat.format_conversations(talks)
    got = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["learned"]) for r in chat.read_back(made).collect()}
    assert got[1] == ([("user", "</s>[INST]"), ("assistant", "é\U0001F600 ok\n"), ("assistant", "")], "é\U0001F600 ok\n")
    assert got[2] == ([("", "")], "") and got[3][1] == "<|done|><|turn|>" * 2 and got[None][1] == "x" and got[4][1] == ""
    assert chat.format_conversations(talks.where("false")).count() == 0


# --- language model ----------------------------------------------------


def brute_model(texts):
    pairs = Counter()
    for t in texts:
        tokens = ["<s>", *(t or "").lower().split(), "</s>"]
        pairs.update(itertools.pairwise(tokens))
    words = {b for _, b in pairs}
    before = Counter(b for _, b in pairs)
    d = (0.0, *kneser_ney.discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)]))
    w = (0.0, *kneser_ney.discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)]))
    share = sum(w[min(c, 3)] for c in before.values()) / len(pairs)

    def p(a, b):
        low = (before[b] - w[min(before[b], 3)]) / len(pairs) + share / (len(words) + 1)
        follow = {y: c for (x, y), c in pairs.items() if x == a}
        if not follow:
            return low
        uses = sum(follow.values())
        c = follow.get(b, 0)
        return (c - d[min(c, 3)]) / uses + sum(d[min(x, 3)] for x in follow.values()) / uses * low

    return p, words


def test_model_agrees_with_brute_force(spark, docs):
    r = random.Random(4)
    texts = [" ".join(r.choice("a b c d e F g hé".split() + [f"x{r.randrange(60)}"]) for _ in range(r.randrange(30))) for _ in range(60)]
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "never seen a"), (None, "a b"), (1, texts[1])]
    table = docs(rows)
    train = table.where("doc_id < 50")
    p, words = brute_model([t for i, t in rows if i is not None and i < 50])
    for context in ("<s>", "a", "never"):
        assert sum(p(context, b) for b in words) + p(context, "<unk>") == pytest.approx(1)
    got = kneser_ney.score(table, kneser_ney.fit(train)).collect()
    want = []
    for i, t in rows:
        tokens = ["<s>", *(t or "").lower().split(), "</s>"]
        want.append((str(i), len(tokens) - 1, sum(math.log10(p(a, b)) for a, b in itertools.pairwise(tokens))))
    found = sorted((str(x["id"]), x["n_tokens"], x["score"]) for x in got)
    assert [x[:2] for x in found] == [x[:2] for x in sorted(want)]
    assert np.allclose([x[2] for x in found], [x[2] for x in sorted(want)])


def test_model_of_nothing(spark, docs):
    row = kneser_ney.score(docs([(1, "a b")]), kneser_ney.fit(docs([]))).first()
    assert row["n_known"] == 0 and row["score"] == pytest.approx(0)
    assert kneser_ney.score(docs([]), kneser_ney.fit(docs([(1, "a")]))).count() == 0


def test_pieces_of_a_batch_hold_whole_texts():
    assert list(in_pieces([b"x" * 5, b"y" * 50, b"", b"z"], 10)) == [(0, 1), (1, 2), (2, 4)]
    assert list(in_pieces([], 10)) == []
