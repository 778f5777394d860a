"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is a start mark, the role, a middle mark, the
text and an end mark. Control strings in roles and texts are escaped by a character after
their first one, which undoes exactly. The rendered text is encoded once, with the offsets
of every token; the marks are special tokens, so no token crosses the bounds of a turn, and
a long conversation is encoded in runs of turns, which gives the tokens of the whole.
Turn spans and token spans are both sorted, and a binary search finds the tokens of each
assistant text: those are the loss mask.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.llm.common import bounded_batches, returning

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters of turns that are encoded at once.
RUN_CHARS = 256 * 1024
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and strings that must not appear unescaped inside texts."""

    start: str = "<|turn|>"
    middle: str = "<|says|>"
    end: str = "<|done|>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
    escape: str = "\\"
    learned: tuple[str, ...] = field(default=("assistant",))

    def __post_init__(self):
        strings = self.all
        for a in strings:
            if len(a) < 2 or self.escape in a:
                raise ValueError(f"{a!r} cannot be escaped")
            for b in strings:
                if any(a.endswith(b[:k]) for k in range(1, len(b)) if a != b or k < len(a)) or (a != b and a in b):
                    raise ValueError(f"{a!r} and {b!r} may overlap")

    @property
    def all(self) -> tuple[str, ...]:
        return (self.start, self.middle, self.end, *self.controls)

    @cached_property
    def _parts(self) -> tuple[re.Pattern, re.Pattern]:
        e = re.escape(self.escape)
        rest = "|".join(f"(?<={re.escape(c[0])}){{}}(?={e}*{re.escape(c[1:])})" for c in self.all)
        return re.compile(rest.replace("{}", "")), re.compile(rest.replace("{}", e))

    def escaped(self, text: str) -> str:
        return self._parts[0].sub(lambda m: self.escape, text)

    def unescaped(self, text: str) -> str:
        return self._parts[1].sub("", text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[list[str], list[tuple[int, int]]]:
        """The turns of the whole conversation, and where each turn's escaped text lies in it."""
        out, spans, at = [], [], 0
        for role, text in turns:
            head, body = self.start + self.escaped(role) + self.middle, self.escaped(text)
            spans.append((at + len(head), at + len(head) + len(body)))
            out.append(head + body + self.end)
            at = spans[-1][1] + len(self.end)
        return out, spans

    def parse(self, rendered: str) -> list[tuple[str, str]]:
        """The turns of a rendered conversation."""
        turns = []
        for part in rendered.split(self.end)[:-1]:
            role, text = part[len(self.start):].split(self.middle, 1)
            turns.append((self.unescaped(role), self.unescaped(text)))
        return turns


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in the spans, by binary search in the sorted offsets."""
    out = np.zeros(len(starts), bool)
    if spans:
        a, b = np.array(spans, np.int64).T
        first = np.searchsorted(starts, a)
        last = np.maximum(first, np.searchsorted(ends, b, "right"))
        for x, y in zip(first.tolist(), last.tolist()):
            out[x:y] = True
    return out


def covered(rendered: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of text under the mask; tokens that are parts of one character share its offsets."""
    starts, ends = starts[mask], ends[mask]
    if not len(starts):
        return []
    upto = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > upto[:-1])))
    return [rendered[a:b] for a, b in zip(starts[new].tolist(), upto[np.append(new[1:], len(starts)) - 1].tolist())]


def encoded(encoder, parts: list[str], most: int = RUN_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the joined ``parts``, each a rendered turn; runs of them of about ``most`` characters at a time."""
    ids, offsets, at, k = [np.zeros(0, np.int32)], [np.zeros((0, 2), np.int32)], 0, 0
    while k < len(parts):
        run, size = [], 0
        while k < len(parts) and (not run or size + len(parts[k]) <= most):
            run.append(parts[k])
            size += len(parts[k])
            k += 1
        code = encoder.encode("".join(run), add_special_tokens=False)
        ids.append(np.array(code.ids, np.int32))
        offsets.append(np.array(code.offsets, np.int32).reshape(-1, 2) + at)
        at += size
    return np.concatenate(ids), np.concatenate(offsets)


def _tokenizer(file: str, template: Template) -> str:
    """The tokenizer with the marks as special tokens, and offsets that leave no character out, as JSON."""
    from tokenizers import Tokenizer
    from tokenizers.processors import ByteLevel

    tokenizer = Tokenizer.from_file(file)
    tokenizer.add_special_tokens([template.start, template.middle, template.end])
    tokenizer.post_processor = ByteLevel(trim_offsets=False)
    return tokenizer.to_str()


def format_conversations(turns: DataFrame, template: Template = Template(), *, tokenizer_file: str = TOKENIZER,
                         conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, n_turns, ids, mask, starts, ends): one row per conversation; ``mask`` marks the tokens to
    learn, ``starts`` and ``ends`` are the offsets of the tokens in ``formatted``.

    A null role or text is empty; turns go by number (nulls first), then role and text; rows
    that repeat are turns of their own. A conversation of empty texts has empty masks, a
    null conversation id is a conversation, and an empty table gives no rows. A conversation
    is the unit of encoding, so its turns meet in one row.
    """
    from tokenizers import Tokenizer

    spark = turns.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(_tokenizer(tokenizer_file, template))
    kind = turns.schema[conv_col].dataType.simpleString()
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    talks = (
        turns.groupBy(F.col(conv_col).alias("conv_id"))
        .agg(F.array_sort(F.collect_list(F.struct(
            F.col(turn_col).isNotNull().alias("known"), F.coalesce(F.col(turn_col), F.lit(0)).alias("turn"),
            blank(role_col).alias("role"), blank(text_col).alias("text")))).alias("turns"))
        .select("conv_id", F.col("turns").cast("array<struct<known:boolean,turn:bigint,role:string,text:string>>").alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Tokenizer.from_str(shared.value)
        held, size = [], 0
        for batch in batches:
            # one conversation at a time becomes Python objects
            for k in range(batch.num_rows):
                talk = [(t["role"], t["text"]) for t in batch.column(1)[k].as_py()]
                parts, spans = template.render(talk)
                ids, offsets = encoded(encoder, parts)
                mask = masked(offsets[:, 0], offsets[:, 1], [s for (role, _), s in zip(talk, spans) if role in template.learned and s[0] < s[1]])
                held.append((batch.column(0)[k].as_py(), "".join(parts), len(talk), ids, mask, offsets))
                size += sum(map(len, parts))
                if size >= RUN_CHARS:
                    yield _rows(held, batch.schema.field(0).type)
                    held, size = [], 0
            if held:
                yield _rows(held, batch.schema.field(0).type)
                held, size = [], 0

    return talks.mapInArrow(
        run, f"conv_id {kind}, formatted string, n_turns bigint, ids array<int>, mask array<boolean>, starts array<int>, ends array<int>")


def _rows(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names, texts, turns, ids, masks, offsets = zip(*held)
    cuts = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x))) for x in (ids, masks, [o[:, 0] for o in offsets], [o[:, 1] for o in offsets])]
    return pa.RecordBatch.from_arrays(
        [pa.array(names, kind), pa.array(texts, pa.string()), pa.array(turns, pa.int64()), *lists],
        names=["conv_id", "formatted", "n_turns", "ids", "mask", "starts", "ends"])


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, turns, learned): what ``formatted``, its mask and its offsets say: the turns, and the unescaped text under the mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    struct = pa.struct([("role", pa.string()), ("text", pa.string())])

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.columns[2:]
            cuts = lists[0].offsets.to_numpy()
            mask, starts, ends = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            for k in range(batch.num_rows):
                a, b = cuts[k] - cuts[0], cuts[k + 1] - cuts[0]
                text = batch.column(1)[k].as_py()
                learned = "".join(template.unescaped(x) for x in covered(text, starts[a:b], ends[a:b], mask[a:b]))
                turns = [{"role": r, "text": t} for r, t in template.parse(text)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([turns], pa.list_(struct)), pa.array([learned], pa.string())],
                    names=["conv_id", "formatted", "turns", "learned"])

    return formatted.select("conv_id", "formatted", "mask", "starts", "ends").mapInArrow(
        run, f"conv_id {kind}, formatted string, turns {_TURNS}, learned string")
