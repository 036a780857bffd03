"""Packing: every id in one piece, no gaps, little padding; ids as the tokenizers library gives them."""

from collections import defaultdict

import numpy as np
import pytest
from helpers import ODD, docs_frame, prose
from tokenizers import Tokenizer

from strikeline.llm import packing
from strikeline.llm.queries import vocabulary

FILE = "byte_bpe_50k.json"


def pieces(df):
    return df.toPandas()


def check(got, texts, ids, end=0, longest=1024):
    coder = Tokenizer.from_file(vocabulary(FILE))
    want = {i: coder.encode(t or "", add_special_tokens=False).ids + [end] for i, t in zip(ids, texts)}
    have = defaultdict(list)
    for r in got.itertuples():
        have[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        assert r.doc_tokens == len(want[r.doc_id]) and r.length == len(np.frombuffer(r.ids, "<u4"))
    for i, w in want.items():
        rows = sorted(have[i])
        assert [s for s, _ in rows] == [sum(len(x) for _, x in rows[:k]) for k in range(len(rows))]
        assert sum((x for _, x in rows), []) == w
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, g in by:
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= longest and g.context.nunique() == 1
    return by.length.sum()


def test_odd_texts_and_special_strings(spark):
    texts = [*ODD, "before <|endoftext|> after", "don't  we'll\n\n x"]
    ids = list(range(1, len(texts) + 1))
    check(pieces(packing.pack(docs_frame(spark, texts, ids, clashes=True).coalesce(1), vocabulary(FILE))), texts, ids)


def test_padding_is_small_and_groups_are_even(spark):
    texts = [" ".join(prose(n, n)) for n in range(5, 900, 7)]
    ids = list(range(len(texts)))
    got = pieces(packing.pack(docs_frame(spark, texts, ids).coalesce(1), vocabulary(FILE), pool=16, step_tokens=4096))
    total = check(got, texts, ids)
    short = total[~total.isin([2**k for k in range(11)])]
    assert len(short) <= 1
    steps = got.groupby(["context", "step_group"]).length.sum()
    assert (steps <= 4096).all() and (steps == 4096).sum() >= len(steps) - 5


def test_null_ids_repeated_rows_and_no_rows(spark):
    df = docs_frame(spark, ["one two", "one two", "three"], [None, 7, 7])
    got = pieces(packing.pack(df, vocabulary(FILE)))
    assert len(got) >= 3 and got.length.sum() == 8
    assert packing.pack(df.limit(0), vocabulary(FILE)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, vocabulary(FILE), tiers=(1000,))


def test_packer_fills_windows_without_loss():
    p = packing.Packer((8, 16, 32), 0, 64)
    for key, n in enumerate([1, 5, 9, 17, 31, 33, 64, 3, 3, 3, 12, 2]):
        p.add((key, None), n)
        if p.waiting > 3:
            p.flush(False)
    p.flush(True)
    assert sum(r[2] for r in p.rows) == 183 and p.waiting == 0
    filled = defaultdict(int)
    for r in p.rows:
        filled[r[4]] += r[2]
    assert sum(n not in (8, 16, 32) for n in filled.values()) <= 1


def test_runs_of_two_million_characters(spark):
    texts = [" " * 2_000_000, "x" + "\n" * 1_500_000 + "y", "a" * 2_000_000, "-" * 2_000_000, "short"]
    check(pieces(packing.pack(docs_frame(spark, texts).coalesce(1), vocabulary(FILE))), texts, [1, 2, 3, 4, 5])


def test_the_pool_keeps_only_the_rest_of_a_long_document():
    packer = packing.Packer((1024, 512), 0, 16384)
    data = bytes(4 * 100_500)
    packer.add((7, data, 0), 100_500, lambda start: (7, data[4 * start :], start))
    held = [p for length in packer.by_length for p in length]
    assert [(len(k[1]), k[2], start, n) for k, start, n, _ in held] == [(4 * (100_500 % 1024), 100_500 // 1024 * 1024, 100_500 // 1024 * 1024, 100_500 % 1024)]
