"""Quality classifier: a byte-level convolutional network in numpy.

Input channels of a byte are the byte itself and a code of eight bits saying which of
the sixteen bytes before it it repeats, two to a bit (text that loops shows there). Filters six bytes
wide run over the whole text in steps of two; their rectified answers are max- and mean-pooled over
chunks of 512 bytes that overlap by half; a hidden layer reads each chunk, and the
maximum and mean of its units over all chunks make one probability.

The network is fitted in one task on a sample of labelled rows whose size is a
parameter. Scoring runs over Arrow batches, whole texts, without a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.llm.common import fold, ids_and_texts, in_pieces, labelled_sample, returning, sheltered, utf8

FILTERS, WIDTH, CODE_WIDTH, HIDDEN, STRIDE = 8, 6, 2, 24, 2
BLOCK = 256
#: How far back a repeat is looked for; more than a filter reads ahead.
GAP = 16
PER_CLASS = 1200
EPOCHS, BATCH, RATE, DECAY = 6, 24, 0.005, 1e-4
PIECE_BYTES = 32 * 1024


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in blocks, what each repeats, which positions are text, each text's first block and number of blocks.

    A text that leaves less than ``GAP`` of its last block free is followed by an empty
    block, so that no filter and no repeat reaches from one text into another.
    """
    sizes = np.array([len(x) for x in texts])
    blocks = np.maximum(1, -(-sizes // BLOCK))
    first = np.concatenate([[0], np.cumsum(blocks + (blocks * BLOCK - sizes < GAP))])
    data = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
    real = np.zeros(first[-1] * BLOCK, bool)
    code = np.zeros(len(data), np.uint8)
    for x, b in zip(texts, first[:-1] * BLOCK):
        data[b : b + len(x)] = np.frombuffer(x, np.uint8)
        real[b : b + len(x)] = True
    for lag in range(1, GAP + 1):
        code[lag:] |= ((data[lag:] == data[:-lag]) & (data[lag:] > 0)).astype(np.uint8) << np.uint8((lag - 1) // 2)
    return data.astype(np.intp), code.astype(np.intp), real, first[:-1], blocks


def _convolve(net: dict, data: np.ndarray, code: np.ndarray, real: np.ndarray) -> np.ndarray:
    """(blocks, positions, filters); a filter is a table of answers for each of its bytes, so no product is needed."""
    n = len(real)
    out = net["byte"][0].take(data[:n:STRIDE], axis=0)
    more = np.empty_like(out)
    for name, source, start, width in (("byte", data, 1, WIDTH), ("code", code, 0, CODE_WIDTH)):
        for j in range(start, width):
            net[name][j].take(source[j : n + j : STRIDE], axis=0, out=more, mode="clip")
            out += more
    out += net["bias"]
    np.maximum(out, 0, out=out)
    out *= real[::STRIDE, None]
    return out.reshape(-1, BLOCK // STRIDE, FILTERS)


def _chunks(first: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two neighbouring blocks make a chunk, the only block of a short text one by itself; and each text's first chunk."""
    left, right, start = [], [], [0]
    for a, n in zip(first, blocks):
        left.append(np.arange(a, a + max(1, n - 1)))
        right.append(np.minimum(left[-1] + 1, a + n - 1))
        start.append(start[-1] + len(left[-1]))
    return np.concatenate(left), np.concatenate(right), np.array(start)


def _blocks(net: dict, data: np.ndarray, code: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(answers, top, mean, share) of every block by itself."""
    answers = _convolve(net, data, code, real)
    share = np.maximum(1, real[::STRIDE].reshape(len(answers), -1).sum(axis=1))[:, None].astype(np.float32)
    return answers, answers.max(axis=1), answers.sum(axis=1) / share, share


def _pooled(net: dict, texts: list[bytes]) -> dict:
    data, code, real, first, blocks = _layout(texts)
    answers, top, mean, share = _blocks(net, data, code, real)
    left, right, start = _chunks(first, blocks)
    z = np.concatenate([np.maximum(top[left], top[right]), (mean[left] + mean[right]) / 2], axis=1)
    return {"data": data, "code": code, "answers": answers, "top": top, "share": share, "left": left, "right": right, "start": start, "z": z}


def _head(net: dict, z: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = np.maximum(z @ net["w1"] + net["b1"], 0)
    counts = np.diff(start)[:, None]
    d = np.concatenate([np.maximum.reduceat(h, start[:-1]), np.add.reduceat(h, start[:-1]) / counts], axis=1)
    return h, d, d @ net["w2"] + net["b2"]


def _table_gradient(index: np.ndarray, grads: np.ndarray) -> np.ndarray:
    """Sum of gradient rows by table entry."""
    out = np.empty((256, FILTERS), np.float32)
    for f in range(FILTERS):
        out[:, f] = np.bincount(index, grads[:, f], minlength=256)
    return out


def _gradients(net: dict, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict:
    p = _pooled(net, texts)
    z, start, left, right = p["z"], p["start"], p["left"], p["right"]
    h, d, logit = _head(net, z, start)
    g = ((1 / (1 + np.exp(-logit)) - y) * weight / len(y)).astype(np.float32)
    out = {"w2": d.T @ g, "b2": g.sum(keepdims=True)}
    gd = np.outer(g, net["w2"])
    counts = np.diff(start)
    of = np.repeat(np.arange(len(y)), counts)
    gh = gd[of, HIDDEN:] / counts[of][:, None]
    gh += gd[of, :HIDDEN] * (h == d[of, :HIDDEN]) * (h > 0)
    gh *= h > 0
    out["w1"], out["b1"] = z.T @ gh, gh.sum(axis=0)
    gz = gh @ net["w1"].T
    top, share, answers = p["top"], p["share"], p["answers"]
    gtop, gmean = np.zeros_like(top), np.zeros_like(top)
    from_left = top[left] >= top[right]
    np.add.at(gtop, left, gz[:, :FILTERS] * from_left)
    np.add.at(gtop, right, gz[:, :FILTERS] * ~from_left)
    np.add.at(gmean, left, gz[:, FILTERS:] / 2)
    np.add.at(gmean, right, gz[:, FILTERS:] / 2)
    gmean /= share
    best = answers.argmax(axis=1)
    block, f = np.nonzero((gtop != 0) & (top > 0))
    sparse = block * BLOCK + best[block, f] * STRIDE
    amount = gtop[block, f]
    dense = (gmean[:, None, :] * (answers > 0)).reshape(-1, FILTERS).astype(np.float32)
    at = np.arange(0, len(answers) * BLOCK, STRIDE)
    out["bias"] = np.bincount(f, amount, minlength=FILTERS) + dense.sum(axis=0)
    for name, source, width in (("byte", p["data"], WIDTH), ("code", p["code"], CODE_WIDTH)):
        parts = []
        for j in range(width):
            t = _table_gradient(source[at + j], dense)
            np.add.at(t, (source[sparse + j], f), amount)
            parts.append(t)
        out[name] = np.stack(parts)
    return out


def fit(texts: list[bytes], y: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> dict:
    """Adam on the log loss, both classes with equal weight."""
    rng = np.random.default_rng(seed)
    f32 = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
    net = {
        "byte": f32(WIDTH, 256, FILTERS), "code": f32(CODE_WIDTH, 256, FILTERS), "bias": np.zeros(FILTERS, np.float32),
        "w1": f32(2 * FILTERS, HIDDEN) * 2, "b1": np.zeros(HIDDEN, np.float32),
        "w2": f32(2 * HIDDEN) * 2, "b2": np.zeros(1, np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32)
    step, steps = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            grads = _gradients(net, [texts[i] for i in part], y[part], weight[part])
            step += 1
            rate = RATE * min(1, step / 20) * (1 - 0.95 * step / steps)
            for name, g in grads.items():
                g = g + DECAY * net[name]
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                net[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return net


def _logit(net: dict, top: np.ndarray, mean: np.ndarray) -> float:
    """One text from its blocks alone: sums do not depend on what else is scored."""
    left, right, start = _chunks(np.zeros(1, np.int64), np.array([len(top)]))
    z = np.concatenate([np.maximum(top[left], top[right]), (mean[left] + mean[right]) / 2], axis=1)
    return float(_head(net, z, start)[2][0])


def logits(net: dict, texts: list[bytes]) -> np.ndarray:
    """One number for each whole text, the same whatever other texts there are.

    Long texts are convolved piece by piece, in whole blocks, with a block of context at both ends.
    """
    out = np.empty(len(texts))
    for lo, hi in in_pieces(texts, PIECE_BYTES):
        if hi - lo > 1 or len(texts[lo]) <= 2 * PIECE_BYTES:
            data, code, real, first, blocks = _layout(texts[lo:hi])
            _, top, mean, _ = _blocks(net, data, code, real)
            out[lo:hi] = [_logit(net, top[a : a + n], mean[a : a + n]) for a, n in zip(first, blocks)]
        else:
            text, size, tops, means = texts[lo], PIECE_BYTES // BLOCK * BLOCK, [], []
            for at in range(0, len(text), size):
                before = BLOCK if at else 0
                data, code, real, _, _ = _layout([text[at - before : at + size + BLOCK]])
                _, top, mean, _ = _blocks(net, data, code, real)
                a, n = before // BLOCK, -(-min(size, len(text) - at) // BLOCK)
                tops.append(top[a : a + n])
                means.append(mean[a : a + n])
            out[lo] = _logit(net, np.concatenate(tops), np.concatenate(means))
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> dict:
    """{"net", "shift"}: the network and the log odds of the classes among training labels; net is None without both.

    At most ``per_class`` rows of each class, outside fold 0, go to the one task that fits.
    """
    counts = {r[0]: r["n"] for r in labels.where(F.col(label).isNotNull() & (fold() != 0))
              .groupBy(F.col(label).cast("int")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    shift = float(np.log((ones + 0.5) / (zeros + 0.5)))
    if not ones or not zeros:
        return {"net": None, "shift": shift}

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, x, y) for b in batches for i, x, y in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist()))
        if rows:
            net = fit([x for _, x, _ in rows], np.array([y for *_, y in rows], np.float32))
            yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps(net)], pa.binary())})

    sample = labelled_sample(docs, labels, label, per_class).repartition(1)
    found = sample.mapInArrow(run, "net binary").collect()
    return {"net": pickle.loads(found[0]["net"]) if found else None, "shift": shift}


@returning
def _score(batches: Iterator[pa.RecordBatch], shared, text: str, to: str) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        texts = utf8(batch.column(batch.schema.names.index(text)))
        raw = logits(model["net"], texts) if model["net"] is not None else np.zeros(len(texts))
        score = 1 / (1 + np.exp(-(raw + model["shift"])))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, to])


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1 for each row of ``docs``, from the text alone.

    A null or empty text is scored as no bytes at all; equal texts score equally; a table
    without rows gives none. If the training labels lacked a class, all scores are its share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    return ids_and_texts(docs, id_col, text_col).mapInArrow(
        lambda it: (b.select(["id", "score"]) for b in _score(it, shared, "text", "score")), f"id {kind}, score double"
    )


@sheltered
def keep_good(docs: DataFrame, model: dict, *, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with their columns as they are."""
    from docmosaic.llm.common import bounded_batches

    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.mapInArrow(
        lambda it: _score(it, shared, text_col, "__score"), docs.withColumn("__score", F.lit(0.0)).schema
    )
    return scored.where(F.col("__score") >= least).drop("__score")
