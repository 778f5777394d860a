"""SentencePiece encoding and decoding by Gumbel top-k over the segmentation lattice.

The pieces of a public model span a lattice over each text. A Gumbel variable on every
complete path, conditioned top-down so that the maximum over a set of paths is drawn
before its members, turns "k samples without replacement" into "the k best paths of a
perturbed lattice". A* search finds them: its bounds are those maxima themselves, hence
exact, and each pop from the queue completes one more distinct path. The key left on
top of the queue afterwards is the threshold for the inclusion scores.

No piece crosses from other characters into white space, so the lattice is a chain of word
lattices. A task builds the lattices of the distinct words of a block once, with numpy: a
trie walk finds the edges, sums run from the ends of words. Fresh paths through all words
of the block are drawn in step; the search per text then only picks where to branch.
Random numbers are hashes of (row key, sample, place in the text), so a row's samples do
not depend on how rows are dealt to tasks.

BPE models store merge ranks in place of log-probabilities; a piece of rank r counts as
probability 1 / (r + 8), normalised (a Zipf law). Unigram scores are used as they are.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.llm.common import bounded_batches, in_pieces, mixed, returning, uniform, utf8
from docmosaic.session import BATCH_BYTES

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
#: Text that one lattice is built for: two of them make up a batch.
BLOCK_BYTES = 9 * BATCH_BYTES // 16
#: Piece numbers that are handed on together.
MOST_IDS = 250_000
_NORMAL, _BYTE, _BPE = 1, 6, 2
_RUN, _NOISE, _RUN_WORDS = 192, 23.0, 16384
_MASK, _STEP, _SALT = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_STEPS = np.arange(_RUN, dtype=np.uint64) * np.uint64(_STEP)


class Vocabulary:
    """Pieces, their log-probabilities, and a trie over their characters. Spaces stand for the model's space mark."""

    def __init__(self, model_file: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(Path(model_file).read_bytes())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that leave texts as they are can be decoded exactly")
        self.prefix = " " if spec.add_dummy_prefix else ""
        texts, ids, scores = [], [], []
        self.byte_ids = np.zeros(256, np.int32)
        self.piece_bytes: list[bytes] = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.piece_bytes[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == _NORMAL and p.piece:
                text = p.piece.replace("▁", " ")
                if " " in text.lstrip(" "):
                    raise ValueError(f"piece {i} crosses words")
                texts.append(text)
                ids.append(i)
                scores.append(p.score)
                self.piece_bytes[i] = text.encode()
        if not any(self.piece_bytes[i] for i in self.byte_ids.tolist()):
            raise ValueError("a model with byte pieces is needed")
        if model.trainer_spec.model_type == _BPE:
            p = 1 / (np.arange(len(texts)) + 8.0)
            self.log_p = np.log(p / p.sum())
        else:
            self.log_p = np.array(scores, float)
        self.byte_log_p = float(self.log_p.min()) - 1
        self.ids = np.array(ids, np.int32)
        self._trie(texts)
        self.byte_at = np.concatenate([[0], np.cumsum([len(x) for x in self.piece_bytes])])
        self.byte_data = np.frombuffer(b"".join(self.piece_bytes), np.uint8)

    def _trie(self, texts: list[str]) -> None:
        chars = sorted({c for t in texts for c in t})
        self.char_of = np.zeros(0x110000, np.int32)  # 0: in no piece
        for k, c in enumerate(chars, 1):
            self.char_of[ord(c)] = k
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for k, t in enumerate(texts):
            at = 0
            for c in t:
                at = nodes.setdefault((at, int(self.char_of[ord(c)])), len(nodes) + 1)
            ends[at] = k
        # an open-addressed table from (node, character) to node
        size = 1 << (4 * len(nodes) - 1).bit_length()
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.edge_keys, self.edge_to = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        keys = np.array([(a << 21) | c for a, c in nodes], np.int64)
        for key, at, to in zip(keys.tolist(), self._slot(keys).tolist(), nodes.values()):
            while self.edge_keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.edge_keys[at], self.edge_to[at] = key, to
        self.end = np.full(len(nodes) + 1, -1, np.int32)
        self.end[list(ends)] = list(ends.values())
        self.first = np.full(len(chars) + 1, -1, np.int32)
        for (a, c), b in nodes.items():
            if a == 0:
                self.first[c] = b

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        key = (state.astype(np.int64) << 21) | char
        at = self._slot(key)
        found = self.edge_keys[at]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.edge_keys) - 1)
            found[open_] = self.edge_keys[at[open_]]
            open_ = open_[(found[open_] != key[open_]) & (found[open_] >= 0)]
        return np.where(found == key, self.edge_to[at], -1)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a row of piece numbers (still with the prefix)."""
        starts, sizes = self.byte_at[ids], np.diff(self.byte_at)[ids]
        return self.byte_data[_ragged(starts, sizes)]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + sizes[0] - 1, starts[1], ..."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Lattice:
    """Edges of all distinct words of a block, by the character where they start.

    Word w has the characters from ``start[w]``; node p has the edges from ``off[p]``. An edge
    has its length in characters, the probability ``q`` of being taken from its node, and the
    piece numbers ``ids[id_at[e] : id_at[e] + id_n[e]]``.
    """

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        v = vocabulary
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.concatenate([[0], np.cumsum(size)])
        n = len(code)
        left = np.repeat(self.start[1:], size) - np.arange(n)  # characters to the end of the word
        char = v.char_of[code]
        at = np.flatnonzero(char > 0)
        state = v.first[char[at]]
        at, state = at[state >= 0], state[state >= 0]
        counts = np.zeros(n, np.int32)
        single = np.zeros(n, bool)
        found, length = [], 1
        while len(at):
            end = v.end[state]
            hit = end >= 0
            p = at[hit]
            found.append((p.astype(np.int32), length, end[hit], counts[p]))
            counts[p] += 1
            if length == 1:
                single[p] = True
            more = left[at] > length
            at, state = at[more], state[more]
            state = v.step(state, char[at + length])
            at, state = at[state >= 0], state[state >= 0]
            length += 1
        lone = np.flatnonzero(~single)  # no piece of its own: the character's bytes
        found.append((lone, 1, -1, counts[lone]))
        counts[lone] += 1
        self.off = np.concatenate([[0], np.cumsum(counts)])
        m = int(self.off[-1])
        self.len, piece = np.empty(m, np.int32), np.empty(m, np.int32)
        while found:
            p, k, end, slot = found.pop()
            e = self.off[p] + slot
            self.len[e], piece[e] = k, end
        del e, p, k, end, slot, at, state, single, char
        node = np.repeat(np.arange(n, dtype=np.int32), counts)
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in code[lone].tolist()]
        wide = np.array([len(x) for x in spelled], np.int64)
        bytes_at = len(v.ids) + np.concatenate([[0], np.cumsum(wide)])
        spelled_ids = v.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        self.ids = np.concatenate([v.ids, spelled_ids]).astype(np.int32)
        self.id_at, self.id_n = piece.copy(), np.ones(m, np.uint8)
        plain = np.flatnonzero(piece < 0)  # in the order of the characters, as in ``lone``
        self.id_at[plain], self.id_n[plain] = bytes_at[:-1], wide
        log_p = v.log_p[np.maximum(piece, 0)]
        log_p[plain] = wide * v.byte_log_p
        del piece, plain
        to = node + self.len
        to[self.len == left[node]] = n  # the end of any word
        del node
        self._sum(log_p, to, left, counts)

    def _sum(self, log_p: np.ndarray, to: np.ndarray, left: np.ndarray, counts: np.ndarray) -> None:
        """Log of the mass of all paths from a node to its word's end, nearest nodes first; ``log_p`` turns into ``q``."""
        rest = np.zeros(len(left) + 1)
        # most words are short, and short numbers are sorted by counting
        order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        cuts = np.flatnonzero(np.diff(left[order])) + 1
        for nodes in np.split(order, cuts) if len(order) else ():
            k = counts[nodes]
            e = _ragged(self.off[nodes], k)
            share = log_p[e]
            share += rest[to[e]]
            heads = np.cumsum(k) - k
            top = np.maximum.reduceat(share, heads)
            share -= np.repeat(top, k)
            np.exp(share, out=share)
            total = np.add.reduceat(share, heads)
            rest[nodes] = top + np.log(total)
            share /= np.repeat(total, k)
            log_p[e] = share
        self.q = log_p

    def spell(self, edges: np.ndarray) -> np.ndarray:
        """The piece numbers of a path."""
        at, n = self.id_at[edges], self.id_n[edges]
        return self.ids[at if n.max(initial=0) < 2 else _ragged(at, n)]

    def choose(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by its probability."""
        out, last = self.off[nodes], self.off[nodes + 1] - 1
        e, q, going = out, self.q[out], None
        more = np.flatnonzero((u > q) & (e < last))
        while len(more):
            going = more if going is None else going[more]
            u, last = u[more] - q[more], last[more]
            e = e[more] + 1
            out[going], q = e, self.q[e]
            more = np.flatnonzero((u > q) & (e < last))
        return out

    def choose_one(self, node: int, u: float) -> int:
        e, last = int(self.off[node]), int(self.off[node + 1]) - 1
        while e < last and u > self.q[e]:
            u -= self.q[e]
            e += 1
        return e


class _Walk:
    """One fresh path through every word of a block: edges in text order; ``at[i]`` is where word i begins."""

    def __init__(self, lattice: Lattice, word: np.ndarray, place: np.ndarray, seed: np.ndarray, salt: int):
        parts = [self._part(lattice, word[i : i + _RUN_WORDS], place[i : i + _RUN_WORDS], seed[i : i + _RUN_WORDS], salt)
                 for i in range(0, len(word), _RUN_WORDS)]
        taken = [x for x, _ in parts] or [np.zeros(0, np.int64)]
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(taken))])
        self.edge = np.concatenate([x for _, x in parts] or [np.zeros(0, np.int64)])

    @staticmethod
    def _part(lattice: Lattice, word: np.ndarray, place: np.ndarray, seed: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each word, and all their edges; few enough words for the caches of a processor."""
        node, end = lattice.start[word], lattice.start[word + 1]
        counter = _counter(seed, place, salt)
        rows, taken = np.arange(len(word)), np.zeros(len(word), np.int64)
        steps = []
        while len(rows):
            e = lattice.choose(node, uniform(counter))
            steps.append((rows, e))
            size = lattice.len[e]
            node += size
            counter += size.astype(np.uint64) * np.uint64(_STEP)
            going = node < end
            taken[rows[~going]] = len(steps)
            rows, node, end, counter = rows[going], node[going], end[going], counter[going]
        at = np.cumsum(taken) - taken
        edge = np.empty(int(taken.sum()), np.int64)
        for t, (rows, e) in enumerate(steps):
            edge[at[rows] + t] = e
        return taken, edge


def _counter(seed: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """A number for each (row, place in the text, purpose)."""
    return place.astype(np.uint64) * np.uint64(_STEP) + (seed + np.uint64(salt * _SALT & _MASK))


def _log_noise(seed: int, place: int, n: int, salt: int) -> np.ndarray:
    """Logs of exponential variables, at least -NOISE, from 32 bits of the hashed counters of n places on end."""
    x = mixed(_STEPS[:n] + np.uint64((seed + place * _STEP + salt * _SALT) & _MASK)) >> np.uint64(32)
    return np.log(-np.log((x.astype(np.float64) + 0.5) * 2.0**-32))


def _below(phi, top, log_e):
    """A Gumbel variable with location phi, given that it is at most ``top``; e is exponential."""
    return phi - np.logaddexp(phi - top, log_e)


@np.errstate(divide="ignore")
def search(lattice: Lattice, walks: list[_Walk], first: int, last: int, seed: int, k: int) -> list[tuple[np.ndarray, float, float, float]]:
    """The k best perturbed paths through words first..last-1: (edges, log-probability, perturbed value, inclusion)."""
    bits = random.Random(seed).getrandbits
    one = lambda: (bits(53) + 0.5) * 2.0**-53
    out: list[tuple[np.ndarray, float, float]] = []
    queue: list = []
    order = count()
    places = [w.at[first : last + 1] for w in walks]
    fresh = lambda s, word: walks[s].edge[walks[s].at[word] : places[s][-1]]

    def emit(head: np.ndarray, base: float, tail: np.ndarray, inner: int, word: int, value: float, s: int) -> None:
        """A complete path: ``head`` is settled, with log-probability ``base``; siblings along ``tail`` join the queue.

        The first ``inner`` edges of ``tail`` belong to ``word``, the others follow walk ``s``.
        """
        steps = np.minimum(np.log(np.maximum(lattice.q[tail], 1e-300)), 0.0)
        before = base + np.cumsum(steps) - steps
        path = np.concatenate([head, tail])
        out.append((path, base + float(steps.sum()), value))
        if not len(tail):
            return
        # No key exceeds its location by NOISE, and locations fall along the path: behind the place
        # where as many keys as are still wanted beat that, there is nothing to find.
        wanted = k - len(out) + 1
        for lo in range(0, len(tail), _RUN):
            if lo and len(queue) >= wanted and before[lo] + _NOISE < -heapq.nsmallest(wanted, queue)[-1][0]:
                break
            phi = before[lo : lo + _RUN] + np.log1p(-np.exp(steps[lo : lo + _RUN]))
            keys = _below(phi, value, _log_noise(seed, len(head) + lo, len(phi), 16 + s))
            best = (-keys).argpartition(wanted)[:wanted] if len(keys) > wanted else np.arange(len(keys))
            for j in best.tolist():
                if keys[j] > -np.inf:
                    at = lo + j
                    of = word if at < inner else first + int(places[s].searchsorted(places[s][-1] - len(tail) + at, "right")) - 1
                    heapq.heappush(queue, (-keys[j], next(order), path, len(head) + at, float(before[at]), (int(tail[at]),), of))

    tail = fresh(0, first)
    emit(tail[:0], 0.0, tail, 0, first, -math.log(-math.log(one())), 0)
    while queue and len(out) < k:
        key, _, path, j, before, gone, word = heapq.heappop(queue)
        node = int(np.searchsorted(lattice.off, gone[0], "right")) - 1
        edges = [e for e in range(int(lattice.off[node]), int(lattice.off[node + 1])) if e not in gone]
        weight = np.cumsum(lattice.q[edges])
        e = edges[min(int(np.searchsorted(weight, one() * weight[-1])), len(edges) - 1)]
        rest = float(weight[-1] - lattice.q[e])
        if len(edges) > 1 and rest > 0:
            phi = before + math.log(rest)
            heapq.heappush(queue, (-float(_below(phi, -key, np.log(-math.log(one())))), next(order), path, j, before, (*gone, e), word))
        s = len(out)
        at, end = node + int(lattice.len[e]), int(lattice.start[np.searchsorted(lattice.start, node, "right")])
        inner = []
        while at < end:  # the rest of the word where the paths part
            inner.append(lattice.choose_one(at, one()))
            at += int(lattice.len[inner[-1]])
        tail = np.concatenate([np.array(inner, np.int64), fresh(s, word + 1)])
        emit(np.concatenate([path[:j], [e]]), before + math.log(max(float(lattice.q[e]), 1e-300)), tail, len(inner), word, -key, s)
    limit = -queue[0][0] if queue else -math.inf
    return [(p, lp, g, 1.0 if limit == -math.inf else -math.expm1(-math.exp(min(lp - limit, 700.0)))) for p, lp, g in out]


def _words(texts: list[bytes], prefix: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words in the order they come, the number of each word of the texts in turn, and where each text's begin.

    A word is a run of spaces and what follows up to the next space; ``prefix`` precedes every text that is not empty.
    """
    data = b"".join([prefix + x for x in texts if x])
    ends = np.cumsum([0, *(len(prefix) + len(x) if x else 0 for x in texts)])
    space = np.frombuffer(data, np.uint8) == 32
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = space[1:] > space[:-1]
    begins[ends] = True  # also behind the last text
    at = np.flatnonzero(begins)
    found = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), np.searchsorted(at, ends).tolist()


def encode(texts: list[bytes], keys: list, vocabulary: Vocabulary, k: int = SAMPLES) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(row, sample, piece numbers, log-probability, perturbed value, inclusion) for each text in turn."""
    prefix = vocabulary.prefix.encode()
    for lo, hi in in_pieces(texts, BLOCK_BYTES):
        words, word, first = _words(texts[lo:hi], prefix)
        seeds = [xxhash.xxh3_64_intdigest(str(i)) for i in keys[lo:hi]]
        lattice = Lattice(words, vocabulary)
        ends = np.concatenate([[0], np.cumsum(np.diff(lattice.start)[word])])
        place = ends[:-1] - np.repeat(ends[first[:-1]], np.diff(first))
        seed = np.repeat(np.array(seeds, np.uint64), np.diff(first))
        walks = [_Walk(lattice, word, place, seed, s) for s in range(k)]
        del words, word, ends, place, seed
        for i in range(hi - lo):
            if first[i] == first[i + 1]:
                yield lo + i, 0, np.zeros(0, np.int32), 0.0, 0.0, 1.0
                continue
            for s, (edges, log_p, value, share) in enumerate(search(lattice, walks, first[i], first[i + 1], seeds[i], k)):
                yield lo + i, s, lattice.spell(edges), log_p, value, share
        del lattice, walks  # before the next block builds its own


def sample_pieces(docs: DataFrame, *, model_file: str = MODEL, samples: int = SAMPLES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, sample, ids, log_prob, perturbed, inclusion, exact): up to ``samples`` distinct segmentations of each text.

    Samples are numbered from 0 by falling perturbed value. ``inclusion`` is the probability
    that the path is among the samples, given the threshold (1 where a text has no more
    paths). ``exact`` says that decoding gave the text back. A null or empty text has one
    segmentation, of no pieces. Rows that repeat an id and text repeat its samples; a null id
    is a key like another; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(model_file))
    kind = docs.schema[id_col].dataType.simpleString()

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts, keys = utf8(batch.column(1)), batch.column(0).to_pylist()
            held, rows = 0, []
            for row in encode(texts, keys, v, samples):
                rows.append(row)
                held += len(row[2])
                if held > MOST_IDS:
                    yield _rows(batch, rows, texts, v)
                    held, rows = 0, []
            if rows:
                yield _rows(batch, rows, texts, v)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(
        run, f"id {kind}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, exact boolean")


def _rows(batch: pa.RecordBatch, rows: list, texts: list[bytes], v: Vocabulary) -> pa.RecordBatch:
    sizes = np.array([len(r[2]) for r in rows])
    ids = np.concatenate([r[2] for r in rows])
    spelled = np.diff(v.byte_at)[ids]
    data = v.decode(ids).tobytes()
    ends = np.concatenate([[0], np.cumsum(spelled)])[np.concatenate([[0], np.cumsum(sizes)])]
    skip = len(v.prefix)
    exact = [data[a + skip * (b > a) : b] == texts[r[0]] for r, a, b in zip(rows, ends[:-1].tolist(), ends[1:].tolist())]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int32()), lists,
         *(pa.array([r[c] for r in rows], pa.float64()) for c in (3, 4, 5)), pa.array(exact)],
        names=["id", "sample", "ids", "log_prob", "perturbed", "inclusion", "exact"])


def decode_pieces(rows: DataFrame, *, model_file: str = MODEL, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the text of each row of piece numbers; null gives null. Broken bytes come out as replacement marks."""
    bounded_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    @returning
    def run(batches):
        v = shared.value
        for batch in batches:
            texts = []
            for ids in batch.column(batch.schema.names.index(ids_col)).to_pylist():
                data = None if ids is None else v.decode(np.array(ids, np.int64)).tobytes().decode(errors="replace")
                texts.append(data[len(v.prefix):] if data else data)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return rows.mapInArrow(run, rows.withColumn(to, F.lit(None).cast("string")).schema)
