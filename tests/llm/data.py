"""Small documents with the awkward cases of every operator."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, DOC_ID string, score double, key int, n_words string, c0 string"


def words(n: int, seed: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def texts() -> list[str | None]:
    base = words(120, 1)
    near = base[:50] + ["changed"] + base[51:]
    far = base[:60] + words(60, 2)
    passage = words(40, 3)
    long = words(9_000, 4, 5_000)
    return [
        None, "", "   \n\t ", "one two three", "one two three", "ONE two  three",
        " ".join(base), " ".join(near), " ".join(near[:110]), " ".join(far), " ".join(base),
        " ".join(words(30, 5) + passage + words(30, 6)), " ".join(words(20, 7) + passage), " ".join(passage),
        " ".join(long), "\n".join(["The line is here.", "The line is here.", "a | b | c | d", "Été à la plage, 日本語 text…"] * 3),
        "word " * 80, "x" * 5_000, "a b c d", "<|endoftext|> 0 ! 0",
    ]


def documents(spark, copies: int = 1):
    """Columns that clash with the operators' own, a null id and repeated rows included."""
    rows = [(i * 3, t, "x", 0.5, 7, "y", "z") for i, t in enumerate(texts())]
    rows += [(None, "a text without an id, of nine words here", "x", 0.1, 1, "y", "z"), rows[6], rows[11]]
    return spark.createDataFrame(rows * copies, SCHEMA).toDF("doc_id", "text", "DOC_ID", "score", "key", "n_words", "c0")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
