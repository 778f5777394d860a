"""Document fingerprints: one-permutation MinHash, optimally densified, with b-bit storage. Column functions only.

Each shingle of five words is hashed once. The top bits of a hash name a bin, and the
smallest hash of a bin represents it. An empty bin borrows from the first non-empty bin
on a probe sequence of its own, fixed for all documents, which visits every bin. Of each
bin the eight low bits are kept, eight bins to a long. Two fingerprints agree in a bin by
chance with probability 2**-8; the estimate of their Jaccard similarity takes that out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmosaic.llm.common import sheltered

BIN_BITS, VALUE_BITS, WORDS = 7, 8, 5
BINS, PER_LONG = 1 << BIN_BITS, 64 // VALUE_BITS
#: Start and (odd) stride of the probe sequence of each bin, by a rule.
_START = [(i * i * 29 + i * 83 + 17) % BINS for i in range(BINS)]
_STRIDE = [((i * 53 + i * i * 7 + 11) % BINS) | 1 for i in range(BINS)]
_EARLY = 12
ROWS_PER_RANGE, MOST_RANGES = 20_000, 4096


def _bin(x: Column) -> Column:
    """The top bits of a hash, so that bins rise with signed hashes."""
    return F.shiftright(x, 64 - BIN_BITS).cast("int") + F.lit(BINS // 2)


@sheltered
def with_fingerprint(docs: DataFrame, text: str, to: str) -> DataFrame:
    """``docs`` with ``to``: the packed fingerprint of ``text`` (array<bigint>).

    Words are lower-cased and end at ASCII white space; a text of fewer than five words is
    one shingle, so a null or empty text (no words) has a fingerprint as well, and equal
    texts have equal ones.
    """
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    words = docs.withColumn("__w", F.split(trimmed, r"[\x20\x09-\x0D]+"))
    last = F.greatest(F.size("__w") - (WORDS - 1), F.lit(1))
    hashed = words.withColumn("__h", F.sort_array(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("__w", i, WORDS)))))
    least = hashed.withColumn("__f", F.filter("__h", lambda x, i: (i == 0) | (_bin(x) != _bin(F.get("__h", i - 1)))))
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(_bin(F.get("__f", k - 1)))
    gap = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
    filled = F.concat(
        F.flatten(F.transform("__f", lambda x, k: F.concat(gap(_bin(x) - before(k) - 1), F.array(x)))),
        gap(F.lit(BINS - 1) - _bin(F.element_at("__f", -1))),
    )
    start, stride = F.array(*map(F.lit, _START)), F.array(*map(F.lit, _STRIDE))
    low = (1 << VALUE_BITS) - 1

    def probe(i: Column, y: Column) -> Column:
        """When bin i comes to the bin of y, above the low bits of y."""
        turn = ((_bin(y) - F.get(start, i)) * F.get(stride, i)).bitwiseAND(BINS - 1)
        return F.shiftleft(turn, VALUE_BITS).cast("bigint").bitwiseOR(y.bitwiseAND(low))

    def packed(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda k: F.aggregate(
            F.slice(values, k * PER_LONG + 1, PER_LONG), F.lit(0).cast("bigint"),
            lambda s, v: F.shiftleft(s, VALUE_BITS).bitwiseOR(v.cast("bigint"))))

    def borrowed(own: Column) -> Column:
        """Own values, else that of the first non-empty bin: a few probes in turn, then the least turn of all."""
        early = [F.array(*(F.lit((_START[i] + t * pow(_STRIDE[i], -1, BINS)) % BINS) for i in range(BINS))) for t in range(_EARLY)]
        return F.transform(own, lambda x, i: F.coalesce(
            x, *(F.get(own, F.get(at, i)) for at in early), F.array_min(F.transform("__f", lambda y: probe(i, y)))
        ).bitwiseAND(low).cast("int"))

    values = _bound(filled, lambda own: _bound(borrowed(own), packed))
    return least.withColumn(to, values).drop("__w", "__h", "__f")


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hex_of(packed: str) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, from 0 to 1."""

    def agreeing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.lit(PER_LONG) - F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    share = F.aggregate(F.zip_with(a, b, agreeing), F.lit(0), lambda s, x: s + x) / F.lit(BINS)
    chance = 2.0**-VALUE_BITS
    return F.greatest(F.lit(0.0), (share - chance) / (1 - chance))


@sheltered
def with_next(docs: DataFrame, order: str, carried: dict[str, str], prepare=lambda rows: rows) -> DataFrame:
    """``docs`` with columns of the row that follows by falling ``order``; the first follows the last.

    Rows without a value of ``order`` come last; ties follow each other by a hash of ``text``.
    The rows are dealt by ranges of ``order`` (bounds from approximate quantiles), and each
    range gets a guard: a copy of the row that comes after its own last one. ``prepare`` makes
    columns to carry that a row has by itself.
    """
    spark = docs.sparkSession
    rows = docs.count()
    parts = max(1, min(MOST_RANGES, rows // ROWS_PER_RANGE))
    bounds = docs.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)] or [0.5], 10000)).first()[0] or []
    limits = F.array(*map(F.lit, sorted(set(bounds))))
    # range 0 holds the rows without a value
    part = F.when(F.col(order).isNull(), 0).otherwise(F.size(F.filter(limits, lambda x: x < F.col(order))) + 1)
    keyed = docs.withColumns({"__part": part, "__tie": F.xxhash64("text")})
    heads = keyed.groupBy("__part").agg(F.max(F.struct(F.col(order).alias("o"), F.col("__tie").alias("t"))).alias("h")).collect()
    heads.sort(key=lambda r: -r["__part"])  # at most MOST_RANGES + 1 of them
    guards = [(r["h"]["o"], r["h"]["t"], heads[i - 1]["__part"]) for i, r in enumerate(heads)]
    kind = docs.schema[order].dataType.simpleString()
    places = F.broadcast(spark.createDataFrame(guards, f"__o {kind}, __t bigint, __to int"))
    guard = keyed.join(places, F.col(order).eqNullSafe(F.col("__o")) & (F.col("__tie") == F.col("__t"))).withColumn(
        "__part", F.col("__to")).drop("__o", "__t", "__to")
    both = prepare(keyed.withColumn("__guard", F.lit(0))).unionByName(prepare(guard.withColumn("__guard", F.lit(1))))
    window = Window.partitionBy("__part").orderBy("__guard", F.col(order).desc_nulls_last(), F.col("__tie").desc())
    out = both.withColumns({to: F.lead(c).over(window) for c, to in carried.items()})
    return out.where("__guard = 0").drop("__part", "__tie", "__guard")
