"""Small corpora that the tests of the text operators share."""

import random

MESSY = [
    (1, "one two three four five six seven", "x"),
    (2, None, "x"),
    (3, "", None),
    (None, "one two three four five six seven", None),
    (4, "one two three four five six seven", "y"),
    (4, "one two three four five six seven", "y"),
    (4, "another text under the same number", "y"),
    (5, "é ü 你好 🎉 \n\n\t x@y.example.org +1 (555) 555-0100", "z"),
    (6, "word " * 3000, "z"),
]

#: Names that operators use inside or return, as further columns of the input.
CLASHING = ["spans", "row_key", "kept", "class_id", "digest", "n_words", "bucket", "score", "samples", "base"]


def messy(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(MESSY, "doc_id long, text string, source string")
    return docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), *[F.lit(-1).alias(c) for c in CLASHING])


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def prose(seed: int, texts: int, vocabulary: str = "a bé ce dod e4 fu go hi ij kk", longest: int = 60):
    """Texts that share long pieces."""
    rng = random.Random(seed)
    words = vocabulary.split()
    pool = [" ".join(rng.choices(words, k=rng.randrange(1, longest))) for _ in range(6)]
    out = []
    for _ in range(texts):
        parts = [p[rng.randrange(len(p)) :][: rng.randrange(1, 250)] for p in rng.choices(pool, k=rng.randrange(0, 5))]
        out.append(rng.choice([" ", "\n", ""]).join(parts))
    return out
