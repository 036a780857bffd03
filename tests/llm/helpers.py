"""Small inputs for the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; an input may have them too.
CLASHES = ["row", "fp", "kept", "clean_text", "n_words", "shard", "size", "key", "cell", "digest", "gone", "leaked", "component_id", "text_id", "unit", "words", "label", "path", "_n", "first_id", "n_same", "line"]


def docs_frame(spark, texts, ids=None, clashes=False):
    """A documents table of these texts; with ``clashes``, columns named like inner ones."""
    ids = range(1, len(texts) + 1) if ids is None else ids
    rows = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, T._parse_datatype_string(DOCS)) if rows else spark.createDataFrame([], DOCS)
    if clashes:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    return df


ODD = [None, "", "   \n\t ", "a", "ein Wort für alle", "same text here, twice over", "same text here, twice over", "x" * 5000, ("word " * 3000).strip(), "a b ﬁ 日本 ▁ K İ", "line one\r\nline two\n\nline one\r\n", " lead and  double  space "]


def prose(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    parts = "the of and er in on re st nd tion ly ing ed th".split()
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
