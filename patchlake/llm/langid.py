"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of anything but letters become one space, and all 1- to 3-grams of characters are
hashed to 2^16 features. Document frequencies are counted over all training rows. The weights are fitted by
follow-the-regularised-leader with L1 and L2 penalties on a bounded sample of training rows per language.
A temperature is then fitted on sample rows set aside and on short cuts of them, which the model can miss. A text that is null or has no letter is `und`.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.llm.bpe import text_slices
from patchlake.llm.memory import released

BITS = 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
SLICE = 1 << 20  # bytes of text whose grams are in memory at a time, but for longer texts
SAMPLE_ROWS = 1500  # training rows per language that the weights are fitted on, about
CALIBRATION = 5  # every fifth sample row sets the temperature
CUTS = (3, 6, 12)  # characters of the cuts of such a row
CUT = -1  # the fold of cuts


class Grams:
    """Hashed n-grams of many texts at once."""

    def __init__(self) -> None:
        self.letter = np.array([unicodedata.category(chr(code))[0] == "L" for code in range(0x40000)])

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features in the order of the texts and of the orders, where each text's begin, letters per text).

        Two spaces stand at both ends of a text, so that every text has a feature.
        """
        codes = [np.frombuffer((text or b"").decode().lower().encode("utf-32-le"), dtype=np.uint32) for text in texts]
        sizes = np.array([len(x) for x in codes])
        flat = np.concatenate([np.zeros(0, dtype=np.uint32), *codes])
        owner = np.repeat(np.arange(len(texts)), sizes)
        letter = self.letter[np.minimum(flat, len(self.letter) - 1)]
        letters = np.bincount(owner[letter], minlength=len(texts))
        flat = np.where(letter, flat, 32)
        same = np.zeros(len(flat), dtype=bool)
        same[1:] = ~letter[1:] & ~letter[:-1] & (owner[1:] == owner[:-1])
        flat, owner = flat[~same].astype(np.uint64), owner[~same]
        counts = np.bincount(owner, minlength=len(texts))
        # Layout: space, the text, space, for each text.
        begins = np.concatenate([[0], (counts + 2).cumsum()])
        padded = np.full(begins[-1], 32, dtype=np.uint64)
        padded[np.arange(len(flat)) + 2 * owner + 1] = flat
        owner = np.repeat(np.arange(len(texts)), counts + 2)
        made, owners = [], []
        for n in ORDERS:
            if len(padded) < n:
                continue
            mixed = np.full(len(padded) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                mixed = (mixed ^ padded[k : len(padded) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            inside = owner[: len(mixed)] == owner[n - 1 :]
            made.append((mixed[inside] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[: len(mixed)][inside])
        return made, owners, letters


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (2^BITS, languages): IDF and scale are multiplied in
    bias: np.ndarray
    temperature: float

    def predict(self, grams: Grams, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, has letters) of each text."""
        features, owners, letters = grams.of(texts)
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for own, owner in zip(features, owners, strict=True):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(starts):
                total[owner[starts]] += np.add.reduceat(self.weights[own], starts, axis=0)
                n[owner[starts]] += np.diff(starts, append=len(owner))
        logits = (total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        odds = np.exp(logits - logits.max(1, keepdims=True)) if len(texts) else logits
        odds /= odds.sum(1, keepdims=True)
        best = odds.argmax(1) if len(texts) else np.zeros(0, dtype=int)
        return best, odds[np.arange(len(texts)), best], letters > 0


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many of all texts (one column) each feature occurs; summed in the tasks, then in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total, seen = Grams(), np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            for _, _, values in text_slices(batch.column(0), SLICE):
                features, owners, _ = grams.of(values)
                edges = [np.searchsorted(owner, np.arange(len(values) + 1)).tolist() for owner in owners]
                for k in range(len(values)):
                    for own, edge in zip(features, edges, strict=True):
                        seen[own[edge[k] : edge[k + 1]]] = True
                    at = np.flatnonzero(seen)
                    total[at] += 1
                    seen[at] = False
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["feature", "n"])

    out = np.zeros(1 << BITS, dtype=np.int64)
    for feature, n in texts.mapInArrow(released(run), "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():  # bounded: 2^BITS
        out[feature] = n
    return out


def cuts(text: bytes) -> list[bytes]:
    """Pieces of CUTS characters of a text, as many as are shorter than it, each at a place that the text decides."""
    whole = text.decode()
    places = ((n, zlib.crc32(text, n) % (len(whole) - n)) for n in CUTS if n < len(whole))
    return [whole[at : at + n].encode() for n, at in places]


def _sample(training: DataFrame, rows: int, languages: dict[str, int]) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """About rows training rows per language, chosen by a hash, and cuts of those set aside: language, fold, features and their counts."""
    share = F.lit(0.0)
    for language, n in languages.items():
        share = F.when(F.col("lang") == language, min(1.0, rows / n)).otherwise(share)
    point = F.pmod(F.xxhash64("text", "row"), F.lit(1 << 30))
    chosen = training.where(point < share * float(1 << 30)).select("lang", F.pmod(F.xxhash64("row"), F.lit(CALIBRATION)).cast("int").alias("fold"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for begin, end, values in text_slices(batch.column(2), SLICE):
                langs, folds = (batch.column(k).slice(begin, end - begin).to_pylist() for k in range(2))
                for k in [k for k, fold in enumerate(folds) if fold == 0]:
                    for part in cuts(values[k]):
                        values.append(part)
                        langs.append(langs[k])
                        folds.append(CUT)
                features, owners, _ = grams.of(values)
                edges = [np.searchsorted(owner, np.arange(len(values) + 1)) for owner in owners]
                own = [np.unique(np.concatenate([x[e[k] : e[k + 1]] for x, e in zip(features, edges, strict=True)]), return_counts=True) for k in range(len(values))]
                yield pa.record_batch([pa.array(langs, pa.string()), pa.array(folds, pa.int32()), pa.array([x.astype("<u2").tobytes() for x, _ in own], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in own], pa.binary())], names=["lang", "fold", "features", "counts"])

    rows_found = chosen.mapInArrow(released(run), "lang string, fold int, features binary, counts binary").collect()  # bounded: rows per language, 2^BITS features each
    found = [(lang, fold, np.frombuffer(x, dtype="<u2").astype(np.int64), np.frombuffer(n, dtype="<u4").astype(float)) for lang, fold, x, n in rows_found]
    return sorted(found, key=lambda x: (x[0], x[1], x[2].tobytes(), x[3].tobytes()))


def fit_ftrl(examples: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int, alpha: float, l1: float, l2: float, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader over (class, features, values): weights and bias.

    Only the sums z and n are kept; a weight is zero until |z| exceeds l1.
    """
    shape = ((1 << BITS) + 1, n_classes)  # the last feature is the bias, without penalty
    z, n = np.zeros(shape), np.zeros(shape)
    order = np.random.default_rng(7)

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        first, second = np.full((len(at), 1), l1), np.full((len(at), 1), l2)
        bias = at == 1 << BITS
        first[bias], second[bias] = 0, 1e-6
        return np.where(np.abs(zs) <= first, 0.0, (np.sign(zs) * first - zs) / ((1 + np.sqrt(ns)) / alpha + second))

    for _ in range(passes):
        for k in order.permutation(len(examples)):
            label, at, values = examples[k]
            at, values = np.append(at, 1 << BITS), np.append(values, 1.0)
            w = weights(at)
            logits = values @ w
            odds = np.exp(logits - logits.max())
            odds /= odds.sum()
            odds[label] -= 1
            gradient = values[:, None] * odds
            step = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / alpha
            z[at] += gradient - step * w
            n[at] += gradient**2
    full = weights(np.arange(shape[0]))
    return full[:-1], full[-1]


def fit(training: DataFrame, rows: int = SAMPLE_ROWS, alpha: float = 0.5, l1: float = 0.02, l2: float = 0.01, passes: int = 3) -> LanguageModel:
    """training: row (any key), text, lang; rows without text or language are left out.

    Document frequencies cover all rows; weights and temperature come from about rows rows per language. Of
    one language only, that one is always predicted; of none, everything is `und`.
    """
    training = training.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    languages = dict(sorted(training.groupBy("lang").count().collect()))  # bounded by the number of languages
    names = list(languages)
    if not names:
        return LanguageModel([UNKNOWN], np.zeros((1 << BITS, 1), dtype=np.float32), np.zeros(1), 1.0)
    total = sum(languages.values())
    idf = np.log((1 + total) / (1 + document_frequencies(training.select("text")))) + 1
    sample = _sample(training, rows, languages)
    vectors = [(names.index(lang), fold, at, counts / counts.sum() * idf[at]) for lang, fold, at, counts in sample]
    scale = 1 / max(1e-9, float(np.mean([np.sqrt((x**2).sum()) for _, fold, _, x in vectors if fold >= 0] or [1.0])))
    vectors = [(label, fold, at, x * scale) for label, fold, at, x in vectors]
    w, bias = fit_ftrl([(label, at, x) for label, fold, at, x in vectors if fold > 0], len(names), alpha, l1, l2, passes)
    kept = [(label, x @ w[at] + bias) for label, fold, at, x in vectors if fold <= 0]
    model_weights = (w * (idf * scale)[:, None]).astype(np.float32)
    return LanguageModel(names, model_weights, bias, fit_temperature(kept))


def fit_temperature(held: list[tuple[int, np.ndarray]]) -> float:
    """The temperature of the least mean loss on rows set aside.

    Their labels count as right in all but one of n + 2 cases, so that rows without any error give a temperature
    too; the range that is searched widens until the least loss lies inside.
    """
    labels, logits = np.array([x for x, _ in held], dtype=int), np.array([x for _, x in held])
    if not len(held) or not np.ptp(logits, axis=1).any():
        return 1.0
    doubt = 1 / (len(held) + 2)
    target = np.full(logits.shape, doubt / (logits.shape[1] - 1))
    target[np.arange(len(labels)), labels] = 1 - doubt

    def loss(log_t: float) -> float:
        scaled = logits / np.exp(log_t)
        scaled -= scaled.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(scaled).sum(1)) - (target * scaled).sum(1)))

    low, high = np.log(1 / 20), np.log(20)
    while True:
        grid = np.linspace(low, high, 121)
        best = int(np.argmin([loss(x) for x in grid]))
        if 0 < best < 120 or high - low > 40:
            return float(np.exp(grid[best]))
        low, high = low - 3 * (best == 0), high + 3 * (best == 120)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score (columns of these names are replaced); the text alone decides.

    `und` has the score 1 where the text has no letter: that is certain.
    """
    kept = [name for name in docs.columns if name not in ("lang_pred", "lang_score")]
    docs = docs.select(*kept)
    at = kept.index(text)
    parts = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.bias, model.temperature))  # bounded by the features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grams = LanguageModel(*parts.value), Grams()
        names = np.array([*own.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for begin, end, texts in text_slices(batch.column(at), SLICE):
                best, score, letters = own.predict(grams, texts)
                best, score = np.where(letters, best, len(own.languages)), np.where(letters, score, 1.0)
                rows = batch.slice(begin, end - begin)
                yield pa.record_batch([*rows.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "lang_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.mapInArrow(released(run), schema)


def held_out(doc_id: Column) -> Column:
    """One document in four, by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> LanguageModel:
    """A model from the documents (doc_id, text, lang) that aren't held out."""
    return fit(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("row"), "text", "lang"))
