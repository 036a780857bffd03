"""Benchmark passages: every place within the budget is found; alignment against brute force."""

import random

import pytest
from helpers import ODD, docs_frame, prose

from strikeline.llm import decontaminate as dc

ITEMS = "item_id long, text string"


def sellers(item, region):
    row = [0] * (len(region) + 1)
    for i, c in enumerate(item, 1):
        nxt = [i]
        for j, e in enumerate(region, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (c != e)))
        row = nxt
    return min(row)


def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(3000):
        item = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))
        region, k = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 24))), rng.randint(0, 4)
        got, want = dc.align(item, region, k), sellers(item, region)
        assert (got is None) == (want > k)
        if got:
            assert got[0] == want and sellers(item, region[got[1] : got[2]]) == want


def edited(rng, text, edits):
    c = list(text)
    for _ in range(edits):
        at = rng.randrange(len(c))
        kind = rng.random()
        if kind < 0.4:
            c[at] = rng.choice("qxz")
        elif kind < 0.7:
            del c[at]
        else:
            c.insert(at, rng.choice("qxz"))
    return "".join(c)


@pytest.mark.parametrize("block", [4_000_000, 900])
def test_places_within_the_budget_are_found_and_clean_documents_left(spark, block):
    rng = random.Random(4)
    items = [(i, " ".join(prose(rng.randint(8, 40), 100 + i)).capitalize() + ".") for i in range(12)] + [(50, None), (51, "  "), (52, "tiny q!")]
    texts, want = [], {}
    for d in range(60):
        body = prose(150, d)
        if d % 3 == 0:
            i, item = items[d % 12]
            budget = int(dc.Items([i], [item], 10, 0.08).budget[0])
            changed = edited(rng, item, rng.randint(0, budget)).replace(" ", rng.choice([" ", "\n", "  "]))
            at = rng.randint(0, 150)
            body = [*body[:at], changed, *body[at:]]
            want[d] = i
        texts.append(" ".join(body))
    texts[1] += " a Tiny Q! b"
    want[1] = 52
    docs, bench = docs_frame(spark, texts, range(60), clashes=True), spark.createDataFrame(items, ITEMS)
    got = dc.find_passages(docs, bench, block_chars=block).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(want.items())
    by = dict(items)
    for r in got:
        k = sellers(dc.plain(by[r.item_id]), dc.plain(texts[r.doc_id][r.start : r.end]))
        assert k <= r.edits
    kept = dc.drop_leaked(docs, bench, block_chars=block)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(60)) - set(want)


def test_odd_texts_null_ids_repeated_rows_and_no_rows(spark):
    bench = spark.createDataFrame([(1, "same text here, twice over"), (None, "same text here, twice over"), (2, "x" * 40)], ITEMS)
    docs = docs_frame(spark, ODD, [None, *range(1, len(ODD))])
    got = dc.find_passages(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(5, 1), (5, None), (6, 1), (6, None), (7, 2)}
    assert dc.find_passages(docs.limit(0), bench).count() == 0 and dc.find_passages(docs, bench.limit(0)).count() == 0
    assert dc.drop_leaked(docs, bench.limit(0)).count() == len(ODD) and dc.drop_leaked(docs.limit(0), bench).count() == 0


def test_long_documents_are_hashed_in_stretches(monkeypatch):
    item = " ".join(prose(20, 5))
    text = dc.plain(" ".join([*prose(300, 6), item, *prose(300, 7)]))
    whole = dc.Items([1], [item], 10, 0.08).search(text)
    monkeypatch.setattr(dc, "STRETCH", 64)
    assert dc.Items([1], [item], 10, 0.08).search(text) == whole != []


def test_many_places_of_one_item_do_not_overlap():
    item = " ".join(prose(12, 1))
    text = " ".join(w for k in range(150) for w in (item, item[: len(item) - 2] + "##", *prose(3, k)))
    places = sorted(f[2:] for f in dc.Items([1], [item * 2, ("ab" * 30)][1:], 10, 0.08).search("ab" * 3000))
    assert len(places) > 64 and all(a[1] <= b[0] for a, b in zip(places, places[1:]))
    places = sorted(f[2:] for f in dc.Items([1], [item], 10, 0.08).search(text))
    assert len(places) == 300 and all(a[1] <= b[0] for a, b in zip(places, places[1:]))
