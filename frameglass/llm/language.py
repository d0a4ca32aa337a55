"""Language identification as inference of a mixture of languages.

A language is a distribution over hashed byte trigrams, learned from labelled documents. A document is a mixture of
languages: expectation-maximisation finds the proportions under which its trigrams are likeliest. Which languages
it holds is chosen by penalised likelihood: from all languages on, the one with the least share is left out as
long as the likelihood that is lost is worth less than the penalty of a language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import byte_slices

#: Trigrams are hashed to this many buckets.
BUCKETS = 1 << 15
#: The documented bound of the sample that a model is fitted on: about this many documents of each language.
SAMPLE_DOCS = 20_000
#: More labels than this are taken for an error of the label column.
MAX_LANGUAGES = 1_000
#: Smoothing of a language's distribution, in trigrams of the mean distribution.
SMOOTHING = 2_000.0
#: Neighbouring trigrams share letters, so a trigram counts as a third of an observation.
WEIGHT = 1 / 3
#: Steps of expectation-maximisation at most, and the change of shares at which it ends.
STEPS, STILL = 30, 1e-3
UNKNOWN = "und"

_CHUNK = 1 << 20
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_SPACES = re.compile(rb"  +")


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's trigrams and their counts. All that is no letter counts as one space."""
    data = _SPACES.sub(b" ", b" " + _FOLD[np.frombuffer(text.lower().encode(), np.uint8)].tobytes() + b" ")
    b = np.frombuffer(data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(b) - 2, _CHUNK):  # memory does not follow the length of a text
        c = b[at : at + _CHUNK + 2].astype(np.uint32)
        code = c[:-2] << np.uint32(16) | c[1:-1] << np.uint32(8) | c[2:]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(17), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass(frozen=True)
class Model:
    """Names of languages and the probability of each bucket in each of them."""

    names: tuple[str, ...]
    p: np.ndarray

    def shares(self, text: str, penalty: float = 1.0) -> list[tuple[str, float]]:
        """The languages of a text with their shares, the largest first. `penalty` scales the price of a language,
        half the logarithm of the number of observations."""
        buckets, counts = trigrams(text)
        p, weights = self.p[:, buckets], counts * WEIGHT
        total = weights.sum()
        kept = np.arange(len(self.names))
        price = penalty * 0.5 * np.log(max(total, 2.0))
        share, likelihood = _mixture(p, weights, np.full(len(kept), 1 / len(kept)))
        while len(kept) > 1:
            rest = np.delete(np.arange(len(kept)), np.argmin(share))
            start = np.maximum(share[rest], 1e-9)
            less, less_likelihood = _mixture(p[kept[rest]], weights, start / start.sum())
            if likelihood - less_likelihood > price:
                break
            kept, share, likelihood = kept[rest], less, less_likelihood
        # A single language stands for the text if it is likelier than the one that was left over.
        if len(kept) == 1:
            kept = np.array([np.argmax(np.log(p) @ weights)])
        order = sorted(range(len(kept)), key=lambda i: (-share[i], self.names[kept[i]]))
        return [(self.names[kept[i]], float(share[i])) for i in order]


def _mixture(p: np.ndarray, weights: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of maximal likelihood by expectation-maximisation, and their log-likelihood."""
    total = weights.sum()
    for _ in range(STEPS if len(share) > 1 else 0):
        new = share * (p @ (weights / (share @ p))) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < STILL:
            break
    return share, float(weights @ np.log(share @ p))


def held_out(id_col: str) -> Column:
    """Documents kept for testing: CRC-32 of the id as text leaves 2 when divided by 4. A null id is none."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Learn from the labelled documents that are not held out; None without any.

    Of a language with more than `sample_docs` documents a sample of about that many, drawn by hash of
    the id, is read. Null texts and labels and texts without letters teach nothing.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
        held_out(id_col).alias("out"),
    ).filter("id IS NOT NULL AND lang IS NOT NULL AND NOT out")
    sizes = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} holds more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    share = F.lit(None).cast("double")
    for lang, n in sorted(sizes.items()):
        if n > sample_docs:
            share = F.when(F.col("lang") == lang, sample_docs / n).otherwise(share)
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.coalesce(share, F.lit(1.0)) * (1 << 20)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for start, stop in byte_slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if text and has_letter(text):
                        buckets, n = trigrams(text)
                        np.add.at(held.setdefault(lang, np.zeros(BUCKETS, np.int64)), buckets, n)
        for lang, counts in held.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(counts[found], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    sums = (
        rows.filter(drawn).select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    ).toPandas()  # at most buckets times languages rows
    names = tuple(sorted(set(sums["lang"])))
    if not names:
        return None
    counts = np.zeros((len(names), BUCKETS))
    counts[sums["lang"].map(names.index), sums["bucket"]] = sums["n"]
    own = counts / counts.sum(1, keepdims=True)
    mean = 0.99 * own.mean(0) + 0.01 / BUCKETS
    p = (counts + SMOOTHING * mean) / (counts.sum(1, keepdims=True) + SMOOTHING)
    return Model(names, p)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", penalty: float = 1.0) -> Column:
    """A struct column of `docs`: lang, score (its share of the text) and all languages with their shares.

    A text without letters, or any text without a model, is `und` with score 0 and no languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the number of languages

    def run(texts: pa.Array) -> pa.Array:
        m, out = shared.value, []
        for start, stop in byte_slices(texts):
            for t in texts.slice(start, stop - start).to_pylist():
                found = m.shares(t, penalty) if m and t and has_letter(t) else []
                out.append({"lang": found[0][0] if found else UNKNOWN, "score": min(1.0, found[0][1]) if found else 0.0,
                            "languages": [{"lang": n, "share": s} for n, s in found]})
        kind = pa.struct({"lang": pa.string(), "score": pa.float64(), "languages": pa.list_(pa.struct({"lang": pa.string(), "share": pa.float64()}))})
        return pa.array(out, kind)

    schema = "struct<lang: string, score: double, languages: array<struct<lang: string, share: double>>>"
    # Marked so that a filter on the result is not moved below it, which would infer every text twice.
    return F.arrow_udf(run, schema).asNondeterministic()(F.col(f"`{text_col}`"))


def predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: its id, held_out, lang_pred, score and languages. Only the text decides a prediction."""
    model = fit(docs, id_col, text_col, lang_col, sample_docs)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__fg_text"))
    return rows.withColumn("__fg_found", identify(docs, model, "__fg_text")).select(
        id_col, held_out(id_col).alias("held_out"), F.col("__fg_found.lang").alias("lang_pred"),
        F.col("__fg_found.score").alias("score"), F.col("__fg_found.languages").alias("languages"),
    )


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.0, **options) -> DataFrame:
    """The rows of `docs` whose language is known and has at least the share `min_score`; the label column holds what
    was predicted."""
    model = fit(docs, id_col, text_col, lang_col, **options)
    rows = docs.withColumn("__fg_found", identify(docs, model, text_col))
    kept = rows.filter((F.col("__fg_found.lang") != UNKNOWN) & (F.col("__fg_found.score") >= min_score))
    return kept.select(*[F.col("__fg_found.lang").alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns])
