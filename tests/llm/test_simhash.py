"""Fingerprints and links against brute force."""

import random

import numpy as np
import pytest
import xxhash
from helpers import ODD, docs_frame, prose

from strikeline.llm import links, simhash


def plain_print(text, n=4):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_roots(values, distance):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def near_prints(n, seed):
    """Random values, tight groups around some of them, and values that differ in the sign bit."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) - 2**63 for _ in range(n)}
    for c in list(out)[: n // 10]:
        for _ in range(rng.choice([1, 3, 40])):
            v = c
            for k in rng.sample(range(64), rng.randint(1, 6)):
                v ^= 1 << k if k < 63 else -(2**63)
            out.add(v)
    return sorted(out)


@pytest.mark.parametrize(("distance", "cell"), [(4, 8192), (4, 16), (3, 8192), (0, 8192)])
def test_links_connect_what_brute_force_connects(spark, distance, cell):
    values = near_prints(300, distance + cell)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = simhash.links_within(df, distance, cell)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= distance for r in found.collect())
    got = {r.node: r.root for r in links.components(found, "a", "b").collect()}
    assert {v: got.get(v, v) for v in values} == plain_roots(values, distance)


def test_thresholds_leave_no_pair_out():
    rng = np.random.default_rng(1)
    for m in (2, 3, 4, 5):
        widths = [64 // m] * m
        costs = [np.cumsum(rng.random((50, 5)) * 10, axis=1) for _ in range(m)]
        t = simhash.best_split(widths, costs, 4)
        assert ((t + 1).sum(axis=1) == 5).all() and (t >= -1).all()


def test_few_documents_use_more_parts():
    assert simhash.choose_parts(1_000, 4) >= simhash.choose_parts(10**8, 4) >= simhash.choose_parts(10**11, 4) >= 2


def test_documents_with_odd_texts(spark):
    base = " ".join(prose(200, 9))
    texts = [*ODD, base, base + " more", base.upper(), "one two", "one  two\n"]
    ids = [None, *range(5, 4 + len(texts))]
    got = simhash.near_duplicates(docs_frame(spark, texts, ids, clashes=True), shingle=4, distance=4).collect()
    assert len(got) == len(texts)
    prints = {i: plain_print(t) for i, t in zip(ids, texts)}
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == prints
    roots = plain_roots(sorted({p - 2**64 if p >> 63 else p for p in prints.values()}), 4)
    of = {i: roots[p - 2**64 if p >> 63 else p] for i, p in prints.items()}
    for r in got:
        assert r.component_id == min((i for i in ids if i is not None and of[i] == of[r.doc_id]), default=None)


def test_one_of_each_group_stays_with_its_columns(spark):
    base, other = " ".join(prose(300, 1)), " ".join(prose(300, 2))
    df = docs_frame(spark, [base, base, other, base + " x", other, other, None, ""], [3, 2, 9, 4, 8, 8, None, 1], clashes=True)
    got = simhash.keep_first(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 2, 8]
    assert simhash.keep_first(df.limit(0)).count() == 0
    alone = simhash.keep_first(docs_frame(spark, [base, base], [None, None]))
    assert alone.count() == 1


def edited_copies(groups, copies, most):
    """Copies of a few texts with up to ``most`` words exchanged, so that pairs lie on both sides of similarity 0.8."""
    rng, out = random.Random(groups * copies), []
    for g in range(groups):
        base = prose(400, 100 + g)
        for k in range(copies):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.randint(3, most)):
                words[at] = f"new{g}x{k}x{at}"
            out.append(" ".join(words))
    return out


def plain_kept(texts, distance=12, least=0.8):
    """Brute force: the smallest id of each group of equal fingerprints and similar pairs within the distance."""
    prints = [plain_print(t, 5) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and (prints[a] ^ prints[b]).bit_count() <= distance:
                both = len(sets[a] & sets[b])
                if prints[a] == prints[b] or both >= least * len(sets[a] | sets[b]):
                    low, high = sorted((root[a], root[b]))
                    root = [low if r == high else r for r in root]
    return sorted(i + 1 for i in set(root))


@pytest.mark.parametrize(("groups", "copies", "most"), [(4, 60, 7), (1, 400, 8)])
def test_dense_groups_keep_what_brute_force_keeps(spark, groups, copies, most):
    """Every similar pair within the distance counts, also where a cell holds very many close pairs."""
    texts = edited_copies(groups, copies, most)
    want = plain_kept(texts)
    assert groups < len(want) < len(texts) / 2
    assert sorted(r.doc_id for r in simhash.keep_first(docs_frame(spark, texts)).collect()) == want


def test_dense_groups_that_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash.all_similar_links, "__defaults__", (16,))
    monkeypatch.setattr(links, "PAIRS", 500)
    texts = edited_copies(2, 80, 7)
    assert sorted(r.doc_id for r in simhash.keep_first(docs_frame(spark, texts)).collect()) == plain_kept(texts)


@pytest.mark.parametrize("shape", ["chain", "star", "none"])
def test_components(spark, shape):
    pairs = {"chain": [(i, i + 1) for i in range(40)], "star": [(100, i) for i in range(50)], "none": []}[shape]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {n: 0 for p in pairs for n in p}


@pytest.mark.parametrize("distance", [4, 12])
def test_a_dense_group_is_connected_by_few_links(spark, distance):
    """A thousand values around one centre: far fewer links than pairs, the same components."""
    rng = random.Random(distance)
    centre, values = rng.getrandbits(62), set()
    while len(values) < 1000:
        v = centre
        for k in rng.sample(range(62), rng.randint(1, distance // 2)):
            v ^= 1 << k
        values.add(v)
    values |= {rng.getrandbits(62) for _ in range(300)}
    found = simhash.links_within(spark.createDataFrame([(v,) for v in values], "fp long"), distance)
    rows = found.collect()
    assert len(rows) < 40_000 and all((r.a ^ r.b).bit_count() <= distance for r in rows)
    got = {r.node: r.root for r in links.components(found, "a", "b").collect()}
    assert {v: got.get(v, v) for v in values} == plain_roots(sorted(values), distance)
