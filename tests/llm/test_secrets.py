"""Secret scan: candidates against a plain search, held-out accuracy, odd inputs."""

import random

from helpers import ODD, docs_frame, prose

from strikeline.llm import secrets


def planted(n, seed):
    """Texts with one secret or one look-alike, and whether it is a secret."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        digits = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        kind = [f'token = "{digits}"', f"password={digits[:18]}x9", "AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(15)) + "7", f"user{i}@mail7.example.org", f"192.168.{i % 250}.17", f"555-{1000 + i}-{rng.randint(1000, 9999)}", f"https://h{i}.example.com/a/{i}", f"4{rng.randint(10**14, 10**15 - 1)}"]
        pick = rng.randrange(len(kind))
        words = prose(60, i)
        out.append((" ".join([*words[:30], kind[pick], *words[30:]]), pick < 3))
    return out


def test_held_out_findings_are_told_apart(spark):
    train, test = planted(400, 1), planted(200, 2)
    fitted = secrets.scan(docs_frame(spark, [t for t, _ in train])).select(*secrets.FEATURES, "label")
    got = secrets.scan(docs_frame(spark, [t for t, _ in test]), labelled=fitted).collect()
    by = {}
    for r in got:
        by[r.doc_id] = by.get(r.doc_id, False) or r.is_secret
    right = sum(by.get(i, False) == s for i, (_, s) in enumerate(test, 1))
    assert right >= 0.95 * len(test)
    missed = [i for i, (_, s) in enumerate(test, 1) if s and not by.get(i, False)]
    assert len(missed) <= 3


def test_the_bound_on_fitted_rows(spark):
    df = docs_frame(spark, [t for t, _ in planted(120, 3)])
    assert secrets.scan(df, train_rows=60).where("is_secret").count() > 10


def test_odd_texts_and_columns(spark):
    df = docs_frame(spark, [*ODD, 'password=abcd1234efgh password = "abcd1234efgh"', "secret=''", "x1" * 4000], [None, *range(1, len(ODD) + 3)], clashes=True)
    got = secrets.scan(df).collect()
    assert {(r.doc_id, r.word_no) for r in got} >= {(len(ODD), 0), (len(ODD), 3)}
    assert secrets.scan(df.limit(0)).count() == 0
    assert secrets.scan(df.drop("source")).count() == len(got)
    assert secrets.scan(docs_frame(spark, ["token=abcd1234efgh5678 x"] * 2, [7, 7])).count() == 2
