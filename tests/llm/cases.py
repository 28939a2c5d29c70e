"""Inputs that every operator on documents must take."""

import random

SCHEMA = "doc_id long, text string, size long, h long, print long, shard int, component_id long, length long"


def odd_documents(spark, texts=()):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with inner ones."""
    rng = random.Random(7)
    words = ["the", "Of", "Éa", "ingre", "THE", "x1", "and", "over", "Straße", "lazy", "dog."]
    long_text = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(30_000))
    own = [None, "", " \t\n", "one", "one two", "one two three four five", "one two three four five", long_text, long_text + " end", " \x1c x\x0bY"]
    rows = [(i, t) for i, t in enumerate([*own, *texts])]
    rows += [rows[5], (None, "null id text here and more"), (None, None)]
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
