"""Piece ids against the library on whole texts, and texts back from ids."""

import hashlib
import random
import time

import numpy as np
import pytest
import sentencepiece
from helpers import ODD, docs_frame, prose
from pyspark.sql import functions as F

from strikeline.llm import pieces
from strikeline.llm.queries import QUERIES, vocabulary

FILE = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(FILE))


@pytest.fixture(scope="module")
def own():
    return pieces.pieces_of(vocabulary(FILE))


def ids_of(own, text):
    return np.frombuffer(own.encode(text), "<i4").tolist()


def test_texts_of_pieces_letters_blanks_and_any_characters(own, lib):
    rng, names = random.Random(13), [p for p in own.names if not p.startswith("<")]
    kinds = [
        lambda: "".join(rng.choice(names) for _ in range(rng.randint(1, 8))),
        lambda: "".join(rng.choice("ab c\u2581 \n\t.") for _ in range(rng.randint(0, 30))),
        lambda: "".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0x80, 0xD7FF), rng.randint(0x1F300, 0x1FAFF)])) for _ in range(rng.randint(0, 12))),
        lambda: " " * rng.randint(0, 40) + rng.choice(names) + " " * rng.randint(0, 40),
        lambda: "".join(rng.choice("thenigoas") for _ in range(rng.randint(0, 60))),
        lambda: rng.choice("a-=. \n") * rng.randint(1, 300),
    ]
    for k in range(6000):
        text = kinds[k % len(kinds)]()
        want = lib.encode(text)
        assert ids_of(own, text) == want, text
        assert own.decode(want) == lib.decode(want), text


def test_any_ids_decode_as_in_the_library(own, lib):
    rng = random.Random(14)
    for _ in range(4000):
        ids = [rng.randint(0, 260) if rng.random() < 0.6 else rng.randint(0, len(own.names) - 1) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == lib.decode(ids), ids


def test_no_prefix_of_places_is_left_twice(own):
    """Texts of two million characters in one unit take time in proportion."""
    for text in (" " * 2_000_000, "a" * 2_000_000, "-" * 2_000_000, "ab" * 1_000_000):
        began = time.time()
        assert own.decode(ids_of(own, text)) == text
        assert time.time() - began < 120


def test_compatibility_is_what_merging_the_two_gives(own, lib):
    rng, usable = random.Random(15), [i for p, i in own.ids.items() if "\u2581" not in p and own.compatible(-1, i)]
    seen = set()
    for _ in range(4000):
        a, b = rng.choice(usable), rng.choice(usable)
        both = [i for i in own.split(own.names[a] + own.names[b])]
        assert own.compatible(a, b) == (both == [a, b])
        seen.add(both == [a, b])
    assert seen == {True, False}


def test_frames_keep_rows_and_columns(spark, lib):
    texts = [*ODD, "<s> </s> <unk> <0x0A> x", "a ", "  ", "\u2581\u2581a \u2581 b", " ".join(prose(500, 5)), "\0a", "🙂 👍🏽 é"]
    df = docs_frame(spark, texts, clashes=True).withColumn("IDS", F.lit("x")).withColumn("Decoded", F.lit(1))
    got = pieces.decode_ids(pieces.encode_texts(df, vocabulary(FILE)), vocabulary(FILE)).orderBy("doc_id")
    assert set(got.columns) == {*df.columns, "ids", "decoded"} - {"IDS", "Decoded"}
    rows = got.collect()
    assert [r.ids for r in rows] == [lib.encode(t or "") for t in texts]
    assert [r.decoded for r in rows] == [lib.decode(lib.encode(t or "")) for t in texts]
    assert [r.text for r in rows] == texts


def test_repeated_rows_null_ids_and_no_rows(spark):
    df = docs_frame(spark, ["one two", "one two", None], [None, 7, 7])
    x = pieces.encode_texts(df, vocabulary(FILE))
    assert sorted(len(r.ids) for r in x.collect()) == [0, 2, 2]
    assert pieces.encode_texts(df.limit(0), vocabulary(FILE)).count() == 0
    gone = pieces.decode_ids(x.select(F.when(F.col("text").isNotNull(), F.col("ids")).alias("ids")), vocabulary(FILE)).collect()
    assert sorted(str(r.decoded) for r in gone) == ["None", "one two", "one two"]


def test_query_equals_the_library(spark, sf_dir, lib):
    want = {r.doc_id: lib.encode(r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op13_sentencepiece"](spark, sf_dir).collect():
        ids = want.pop(r.doc_id)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert not want
