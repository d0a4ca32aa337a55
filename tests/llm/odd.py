"""Documents with odd rows, shared by the tests of this folder."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

WORDS = "the licence of and Été Ährig niño 東京 x1 under mit don't we'll 3.14 […]  nbsp wide á <|endoftext|> I".split(" ")


def sentence(seed: int, n: int) -> str:
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str(x % 97) * (x % 3 == 0))
    return " ".join(out)


TEXTS = [
    None, "", " \t\n\x0b\x0c", "a", "A", "Same TEXT here", "same text HERE", "Same TEXT here", "É", "é", "12 !!", "\x00\x1c\x1f x\x85y",
    "  two  spaces\n\n lines \r\n", "x" * 5000, sentence(1, 40), sentence(1, 40).upper(), sentence(2, 3000), "İ K ſ ß",
    "under the mit license apache license version 2", " a  b　\tc", "<|startoftext|>a <|endoftext|>",
]


def rows(times: int = 1) -> list[tuple]:
    texts = TEXTS * times
    return [(i * 3, t, ["en", "fr", None][i % 3], f"src{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]


def docs(spark, times: int = 1):
    return spark.createDataFrame(rows(times), DOCS).repartition(3)


def clashing(df):
    """The same rows beside columns whose names operators might use."""
    from pyspark.sql import functions as F

    names = ("digest body salt keep_id kept group_size shard slot slot_group size rows within first_slot words n_words label labels score "
             "fingerprint component_id tokens n_tokens start length value key id rn path block base_failed host rate lang_pred").split()  # fmt: skip
    return df.withColumns({n: F.lit("mine") for n in names})
