"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, harm, target, negation, reported speech, other. Insults come from
a lexicon of words and stems learned from labelled rows, each with a weight. Four small
transducers read the symbols of a clause and put a factor on each match: whether somebody
is addressed, whether it is negated, whether it is reported, whether harm is announced.
They are composed once into one machine, whose weights add up along a clause. What counts
is the weight of matched clauses, not of words: a document's features are its strongest
clause, the sum over clauses and their density, and a logistic curve fitted on labelled
rows that the lexicon has not seen makes them a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.llm.common import fold, ids_and_texts, labelled_sample, returning, utf8

PER_CLASS = 3000
STEMS = (4, 10)
OTHER, INSULT, HARM, TARGET, NEGATION, REPORT = range(6)

# Words of the closed classes, English, German, French and Spanish.
WORDS = {
    HARM: "kill hurt destroy burn murder stab shoot töten umbringen verletzen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yourself he she him her they them du dich dir dein ihr euch tu toi vous ton votre tú usted ustedes vosotros ti",
    NEGATION: "not never no none isn aren don doesn didn won wouldn nicht nie kein keine niemals ne pas jamais aucun nunca jamás ningún tampoco",
    REPORT: "said says wrote quoted called reported according claimed sagte schrieb nannte laut dit écrit selon dijo escribió llamó según",
}
_TOKEN = re.compile(r"[^\W\d_]+|[.,;:!?|\n]")
_BREAKS = frozenset(".,;:!?|\n")


@dataclass(frozen=True)
class Machine:
    """A deterministic weighted transducer over the symbols: arcs[state][symbol] = (next state, log factor of a match)."""

    arcs: tuple[tuple[tuple[int, float], ...], ...]

    def compose(self, other: Machine) -> Machine:
        """Both at once: the reachable pairs of states, weights added."""
        numbers, todo, arcs = {(0, 0): 0}, [(0, 0)], []
        for a, b in todo:
            row = []
            for (p, v), (q, w) in zip(self.arcs[a], other.arcs[b]):
                if (p, q) not in numbers:
                    numbers[p, q] = len(numbers)
                    todo.append((p, q))
                row.append((numbers[p, q], v + w))
            arcs.append(tuple(row))
        return Machine(tuple(arcs))

    def run(self, symbols: list[int], weights: list[float]) -> float:
        """Total weight of the matches in a clause."""
        state, total = 0, 0.0
        for s, w in zip(symbols, weights):
            state, factor = self.arcs[state][s]
            if w:
                total += w * math.exp(factor)
        return total


def _memory(trigger: int, matched: tuple[int, ...], factor: float, span: int | None) -> Machine:
    """After ``trigger``, matches get ``factor``; for ``span`` symbols, or to the end of the clause."""
    states = 2 if span is None else span + 1
    arcs = []
    for state in range(states):
        row = []
        for s in range(6):
            to = states - 1 if s == trigger else state if span is None else max(0, state - 1)
            row.append((to, math.log(factor) if state and s in matched else 0.0))
        arcs.append(tuple(row))
    return Machine(tuple(arcs))


def grammar() -> Machine:
    """Aimed matches count one and a half times, negated and reported ones less, an insult after harm or harm at a target more."""
    out = _memory(TARGET, (INSULT, HARM), 1.5, None)
    for part in (_memory(HARM, (INSULT, TARGET), 1.5, None), _memory(NEGATION, (INSULT, HARM), 0.5, 3), _memory(REPORT, (INSULT, HARM), 0.5, None)):
        out = out.compose(part)
    return out


class Symbols(dict):
    """(symbol, weight) of a lower-cased token, remembered; a break is None."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.exact = {w: (s, 0.0) for s, words in WORDS.items() for w in words.split()}
        self.exact |= {t: (INSULT, w) for t, w in lexicon.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in lexicon.items() if t.endswith("*")}

    def __missing__(self, token: str):
        if len(self) > 200_000:
            self.clear()
        if token in _BREAKS:
            found = None
        else:
            best = max((self.stems.get(token[:k], 0.0) for k in range(STEMS[0], min(STEMS[1], len(token)) + 1)), default=0.0) if self.stems else 0.0
            found = self.exact.get(token) or (OTHER, 0.0)
            if found[1] < best and found[0] in (OTHER, INSULT):
                found = (INSULT, best)
            if found[0] == HARM:
                found = (HARM, 0.5)
        self[token] = found
        return found


def features(text: str, symbols: Symbols, machine: Machine) -> tuple[float, float, float]:
    """Of the matched clauses: the strongest, the sum, and the sum for each hundred tokens; the last two as logarithms."""
    found = list(map(symbols.__getitem__, _TOKEN.findall(text.lower())))
    strongest = total = 0.0
    end = 0  # clauses before it are done
    for at, x in enumerate(found):
        if at < end or x is None or not x[1]:
            continue
        start = at
        while start > end and found[start - 1] is not None:
            start -= 1
        end = at
        while end < len(found) and found[end] is not None:
            end += 1
        clause = machine.run([x[0] for x in found[start:end]], [x[1] for x in found[start:end]])
        strongest, total = max(strongest, clause), total + clause
    return strongest, math.log1p(total), math.log1p(100 * total / (len(found) + 20))


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Words, and stems marked by a star, that toxic rows have much more often; weight: the log of the ratio.

    A term stays if its count in toxic rows, less two deviations, is three times that in
    the others, plus two deviations.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    longer = F.filter(tokens, lambda t: F.length(t) >= STEMS[0])
    stems = F.flatten(F.transform(longer, lambda t: F.transform(
        F.sequence(F.lit(STEMS[0]), F.least(F.length(t), F.lit(STEMS[1]))), lambda k: F.concat(F.substring(t, F.lit(1), k), F.lit("*")))))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {}
    terms = (
        sample.select("y", F.explode(F.array_distinct(F.concat(tokens, stems))).alias("term"))
        .groupBy("term").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    )
    scale = sizes[1] / sizes[0]
    low, high = F.col("p") - 2 * F.sqrt("p"), (F.col("n") + 2 * F.sqrt(F.col("n") + 1)) * scale
    kept = terms.where(low >= 3 * high).select("term", F.log((F.col("p") + 0.5) / ((F.col("n") + 0.5) * scale)).alias("w"))
    return {r["term"]: r["w"] for r in kept.collect()}  # fewer than 50 terms for each toxic row of the sample


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return w


@returning
def _features(batches: Iterator[pa.RecordBatch], shared, names: list[str], text: int) -> Iterator[pa.RecordBatch]:
    symbols, machine = Symbols(shared.value), grammar()
    for batch in batches:
        rows = [features(x.decode(), symbols, machine) for x in utf8(batch.column(text))]
        columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != text), *columns], names=names)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> dict:
    """{"lexicon", "weights", "shift"} from at most ``per_class`` rows of each class outside fold 0.

    Folds 1 to 3 give the lexicon, fold 4 the curve. Without both classes all scores are
    the share of label 1 among the training labels.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col(label).isNotNull() & (fold() != 0))
    counts = {r[0]: r["n"] for r in marked.groupBy(F.col(label).cast("int")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shift = math.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))
    if len(counts) < 2:
        return {"lexicon": {}, "weights": [0.0] * 4, "shift": shift}
    from docmosaic.session import materialize

    sample = materialize(labelled_sample(docs, labels, label, per_class), "toxicity-sample")
    lexicon = _lexicon(sample.where(fold("id") != 4))
    shared = spark.sparkContext.broadcast(lexicon)
    seen = sample.where(fold("id") == 4).select("y", "text").mapInArrow(
        lambda it: _features(it, shared, ["y", "a", "b", "c"], 1), "y int, a double, b double, c double").collect()
    x, y = np.array([r[1:] for r in seen]).reshape(-1, 3), np.array([r[0] for r in seen], float)
    if len(set(y.tolist())) < 2:
        return {"lexicon": lexicon, "weights": [0.0, 1.0, 0.0, 0.0], "shift": shift}
    weights = _curve(x, y)
    weights[0] -= math.log(y.mean() / (1 - y.mean()))
    return {"lexicon": lexicon, "weights": weights.tolist(), "shift": shift}


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, strongest): the probability that a row is toxic, and the weight of its strongest clause, from the text alone.

    A null or empty text has no clauses; equal texts score equally; a table without rows gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model["lexicon"])
    kind = docs.schema[id_col].dataType.simpleString()
    rows = ids_and_texts(docs, id_col, text_col).mapInArrow(
        lambda it: _features(it, shared, ["id", "a", "b", "c"], 1), f"id {kind}, a double, b double, c double")
    w = model["weights"]
    logit = F.lit(w[0] + model["shift"]) + F.col("a") * w[1] + F.col("b") * w[2] + F.col("c") * w[3]
    return rows.select("id", (1 / (1 + F.exp(-logit))).alias("score"), F.col("a").alias("strongest"))
