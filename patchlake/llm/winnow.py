"""Document fingerprints by winnowing, in DataFrame functions alone.

A text is a sequence of words (runs without white space, cut at WORD_CHARS characters). Every run of GRAM words
has a hash; of every WINDOW neighbouring hashes the smallest is kept, the rightmost of equal ones, with its
position. Two texts that share GRAM + WINDOW - 1 words in a row share a fingerprint at that passage, and no
match shorter than GRAM words is ever reported. A text with fewer words than a gram is one gram; one with
fewer grams than a window is one window; a text without words, or a null one, has an empty fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 5, 6
WORD_CHARS = 24
POSITION_BITS = 25  # 33 million words; the hash has the 38 bits above


def marks(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """df with out: the kept (hash, position) pairs as longs, in the order of the text.

    The position is stored as its complement, so that the least long of a window is its least hash at its
    rightmost place, and both can be read back: see hash_of() and position_of().
    """
    words, grams = f"__llm_words_{out}", f"__llm_grams_{out}"
    last = F.lit((1 << POSITION_BITS) - 1)
    df = df.withColumn(words, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"\S{{1,{WORD_CHARS}}}"), F.lit(0)), lambda word: F.xxhash64(word)))

    def gram_at(i: Column) -> Column:
        hashed = F.xxhash64(*[F.get(F.col(words), i + k) for k in range(gram)])
        return F.shiftleft(F.shiftrightunsigned(hashed, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(last - i)

    def window_at(i: Column) -> Column:
        inside = [F.get(F.col(grams), i + k) for k in range(window)]
        return F.least(*inside) if window > 1 else inside[0]

    def places(array: str, width: int) -> Column:
        n = F.size(array)
        return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    df = df.withColumn(grams, F.transform(places(words, gram), gram_at))
    # A kept hash stays the least of neighbouring windows only, so distinct keeps the order of the text.
    df = df.withColumn(out, F.array_distinct(F.transform(places(grams, window), window_at)))
    return df.drop(words, grams)


def hash_of(mark: Column) -> Column:
    return F.shiftright(mark, POSITION_BITS)


def position_of(mark: Column) -> Column:
    return F.lit((1 << POSITION_BITS) - 1) - mark.bitwiseAND((1 << POSITION_BITS) - 1)


def fingerprint(column: str) -> Column:
    """hash@position for every mark, joined by spaces."""
    return F.array_join(F.transform(column, lambda x: F.concat(F.lower(F.hex(hash_of(x))), F.lit("@"), position_of(x).cast("string"))), " ")


def hashes(column: str) -> Column:
    return F.array_distinct(F.transform(column, lambda x: hash_of(x)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are alike."""
    both, n = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(both / (n - both))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds lie at or below value, found in two steps: a stride, then within it."""
    stride = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(x) for x in bounds[::stride]])
    first = F.size(F.filter(coarse, lambda x: x <= value))
    inside = F.slice(F.array(*[F.lit(x) for x in bounds]), F.greatest(first - 1, F.lit(0)) * stride + 1, F.lit(stride))
    return F.when(first == 0, 0).otherwise((first - 1) * stride + F.size(F.filter(inside, lambda x: x <= value)))


def with_next(docs: DataFrame, order: str, values: list[str], parts: int, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """prepare(docs) with __llm_next_<value>: the values of the next row in descending order, after the last those of the first.

    Rows are cut into ranges of the order column at its quantiles; every range also gets the first row of the
    next one, so that a window over a range sees all it needs. One shuffle of the rows, no global sort.
    Rows that share an order value follow one another by the first of the values, largest first and null last.
    """
    key = F.coalesce(F.col(order), F.lit(-(2**63)))
    docs = docs.withColumn("__llm_key", key)
    quantiles = docs.agg(F.percentile_approx("__llm_key", [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).head()[0]
    bounds = sorted(set(quantiles or [0]))
    ranged = docs.withColumn("__llm_part", _bucket(F.col("__llm_key"), bounds))
    tops = sorted(ranged.groupBy("__llm_part").agg(F.max("__llm_key")).collect())  # bounded: one row per range
    if not tops:
        return prepare(docs).select("*", *[F.col(v).alias(f"__llm_next_{v}") for v in values]).drop("__llm_key")
    # A range goes on with the top of the range below; the lowest one with the top of all.
    follows = [(below, part) for (_, below), (part, _) in zip([tops[-1], *tops[:-1]], tops, strict=True)]
    goes_to = ranged.sparkSession.createDataFrame(follows, "__llm_key long, __llm_to int")
    # Of rows with the same order value, the one that comes first in the window's order.
    leads = F.max_by(F.struct(*ranged.columns), F.struct(F.col(values[0]).isNotNull(), F.col(values[0]))).alias("row")
    borrowed = ranged.join(F.broadcast(goes_to), "__llm_key").groupBy("__llm_key", "__llm_to").agg(leads).select("row.*", "__llm_to").withColumn("__llm_part", F.col("__llm_to"))
    both = prepare(ranged.withColumn("__llm_borrowed", F.lit(False)).unionByName(borrowed.select(*ranged.columns, F.lit(True).alias("__llm_borrowed"))))
    window = Window.partitionBy("__llm_part").orderBy("__llm_borrowed", F.desc("__llm_key"), F.desc(values[0]))
    led = both.select("*", *[F.lead(v).over(window).alias(f"__llm_next_{v}") for v in values])
    return led.where(~F.col("__llm_borrowed")).drop("__llm_key", "__llm_part", "__llm_borrowed")
