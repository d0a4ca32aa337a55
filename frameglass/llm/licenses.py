"""License scans by an exact set-similarity join of text blocks with license templates, with DataFrame functions only.

A block is a window of a text's words, twice as long as the templates of its size class are and half a window after
the one before, so any passage as long as a template lies in one. A block meets a template if it contains at
least `containment` of the template's distinct words.

All documents are read for the frequencies of the template words; words are ordered by these, the rarest first.
If a block shares enough words with a template, the first of them stands early in both (prefix filter), so blocks
are cut only around a template's prefix words and joined on prefix words. A block with too few template words
(length filter), or with too few words left behind the shared one on either side (positional filter), is dropped
before all words are compared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .texts import ascii_lower

#: Words of lower-cased texts: runs of digits, small letters and all characters beyond ASCII.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.9
BLOCKS = "array<struct<stride: int, first: bigint, ranks: array<int>>>"
#: The least half of a window in words.
LEAST_STRIDE = 8

#: Phrases whose words stand one after the other, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices that public licenses ask to be shown, as (label, text).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                 "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either "
              "version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]

    @property
    def distinct(self) -> frozenset[str]:
        return frozenset(self.words)

    def least(self, containment: float) -> int:
        """Words that a block must share."""
        return max(1, math.ceil(containment * len(self.distinct) - 1e-9))

    @property
    def stride(self) -> int:
        return max(LEAST_STRIDE, 1 << (len(self.words) - 1).bit_length())


def templates(texts=TEMPLATES) -> list[Template]:
    """Templates with their words; those without any are left out. The list must fit a driver."""
    letters = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = {c: " " for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)}
    cut = [(label, tuple(w for w in text.translate(letters).translate(other).split(" ") if w)) for label, text in texts]
    return [Template(label, words) for label, words in cut if words]


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def word_order(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Places of the template words in ascending order of the number of documents that hold them."""
    found = words.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("word"))
    counts = {r.word: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # template words
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def _places(words: Column, phrase: str) -> Column:
    """Words at which a phrase begins, from 0."""
    parts = phrase.split()

    def begins(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return found

    rare = max(parts, key=len) if "mit" not in parts else "mit"
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), begins)
    return F.when(F.array_contains(words, rare), places).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts=TEMPLATES, containment: float = CONTAINMENT, phrases=PHRASES) -> tuple[DataFrame, DataFrame]:
    """Two tables: of every row its id, n_words and the places of phrases, and of every block and template that meet
    the row's id, label, template number, first word, words and containment.

    Rows are told apart by id and text. A null text has no words; templates without words match nothing.
    """
    spark = docs.sparkSession
    ts = templates(texts)
    rows = docs.select(
        F.struct(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("body")).alias("key"),
        words_of(F.col(f"`{text_col}`")).alias("words"),
    )
    order = word_order(rows, sorted({w for t in ts for w in t.distinct}))
    ranked = [sorted(order[w] for w in t.distinct) for t in ts]
    least = [t.least(containment) for t in ts]
    prefixes = [r[: len(r) - m + 1] for r, m in zip(ranked, least)]
    by_rank = {i: w for w, i in order.items()}
    strides = sorted({t.stride for t in ts})
    ranks = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))]) if order else None

    def blocks(words: Column, stride: int) -> Column:
        """Blocks of a size class that hold a prefix word: where they begin and their template words in order."""
        prefix = _strings(sorted({by_rank[i] for t, p in zip(ts, prefixes) for i in p if t.stride == stride}))
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(prefix, F.get(words, i)))
        begins = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.floor(i / stride) * stride, F.floor(i / stride) * stride - stride))))
        cut = F.transform(
            F.filter(begins, lambda b: b >= 0),
            lambda b: F.struct(
                F.lit(stride).alias("stride"), b.cast("long").alias("first"),
                F.array_sort(F.array_compact(F.transform(
                    F.array_distinct(F.slice(words, b.cast("int") + 1, 2 * stride)), lambda w: F.try_element_at(ranks, w)
                ))).alias("ranks"),
            ),
        )
        return F.when(F.arrays_overlap(words, prefix), cut).otherwise(F.array().cast(BLOCKS))

    w = F.col("words")
    places = F.array(*[F.struct(F.lit(label).alias("label"), _places(w, p).alias("at")) for p, label in phrases.items()])
    scanned = rows.select(
        "key", F.size(w).cast("long").alias("n_words"), places.cast("array<struct<label: string, at: array<int>>>").alias("places"),
        F.concat(F.array().cast(BLOCKS), *[blocks(w, s) for s in strides]).alias("blocks"),
    )
    path = scratch_path(spark, "licenses")
    scanned.write.parquet(path)
    scanned = spark.read.parquet(path)

    table = [(t.stride, k, t.label, i, at, len(r), m, r) for k, (t, r, m, p) in enumerate(zip(ts, ranked, least, prefixes)) for at, i in enumerate(p)]
    schema = "stride int, template int, label string, rank int, at int, size int, least int, ranks array<int>"
    wanted = F.broadcast(spark.createDataFrame(table, schema).withColumnRenamed("ranks", "template_ranks"))  # a row per prefix word
    block = scanned.select("key", F.explode("blocks").alias("b")).select("key", "b.*")
    fewest = F.create_map(*[x for s in strides for x in (F.lit(s), F.lit(min(m for t, m in zip(ts, least) if t.stride == s)))]) if strides else F.lit(None)
    block = block.withColumn("room", F.size("ranks") - (fewest[F.col("stride")] if strides else F.lit(0)) + 1).filter("room > 0")
    prefix_words = block.select("key", "stride", "first", "ranks", F.posexplode(F.expr("slice(ranks, 1, room)")).alias("place", "rank"))
    pairs = prefix_words.join(wanted, ["stride", "rank"]).filter(
        "size(ranks) >= least AND 1 + least(size - at - 1, size(ranks) - place - 1) >= least"
    )
    shared = F.size(F.array_intersect("ranks", "template_ranks"))
    met = pairs.withColumn("shared", shared).filter("shared >= least").select(
        "key", "label", "template", "first", F.expr("2L * stride").alias("words"), F.expr("shared / size").alias("containment")
    ).distinct()
    return scanned.drop("blocks"), met


def labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Phrases count at every place; labels add those of templates that a block meets. The score is 1 with a
    phrase, else the largest containment, 0 without any. An empty table gives none; repeated rows give
    repeated results.
    """
    scanned, met = scan(docs, id_col, text_col, **options)
    best = met.groupBy("key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    at = F.flatten(F.transform("places", lambda p: p["at"]))
    base = F.transform(F.filter("places", lambda p: F.size(p["at"]) > 0), lambda p: p["label"])
    joined = scanned.join(best, scanned["key"].eqNullSafe(best["key"]), "left").select(
        scanned["key.doc"].alias(id_col), "n_words", at.alias("at"), base.alias("base"),
        F.coalesce("found", F.array().cast("array<string>")).alias("found"), "best",
    )
    return joined.select(
        F.col(f"`{id_col}`"), "n_words", F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
