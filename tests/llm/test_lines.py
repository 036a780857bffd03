"""Line classes against brute force; the edit join finds every pair."""

import random

import pytest
from helpers import ODD, docs_frame, prose

from strikeline.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        nxt = [i]
        for j, e in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (c != e)))
        row = nxt
    return row[-1]


def edited(rng, s, most):
    c = list(s)
    for _ in range(rng.randint(0, most)):
        kind, at = rng.random(), rng.randrange(len(c) + 1)
        if kind < 0.35 and c:
            del c[min(at, len(c) - 1)]
        elif kind < 0.7:
            c.insert(at, rng.choice("xyzß"))
        elif c:
            c[min(at, len(c) - 1)] = rng.choice("xyzß")
    return "".join(c)


def near_lines(n, seed, copies=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        base = " ".join(prose(rng.randint(3, 12), seed * 1000 + k))
        out += [base, *[edited(rng, base, 4) for _ in range(copies)]]
    return out


def test_banded_distance():
    rng = random.Random(3)
    for _ in range(20_000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        b, k = edited(rng, a, 5).replace("x", "a"), rng.randint(0, 4)
        assert lines.within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def plain_classes(docs):
    """Place of the first line of the class of every line; docs: (id, text)."""
    rows = [(d is None, d, lines.text_id(t), i, x.decode()) for d, t in docs for i, x in lines.lines_of(t)]
    known = sorted({r[4] for r in rows})
    root = {x: x for x in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            k = min(2, min(len(a), len(b)) // 20)
            if k and abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                root[find(b)] = find(a)
    first = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1] or 0, r[2], r[3])):
        first.setdefault(find(r[4]), r)
    return {(r[1], r[2], r[3]): (first[find(r[4])][1], first[find(r[4])][3]) for r in rows}


@pytest.mark.parametrize(("seed", "cell"), [(1, 2048), (2, 4)])
def test_classes_match_brute_force(spark, monkeypatch, seed, cell):
    monkeypatch.setattr(lines, "line_links", lambda texts, _f=lines.line_links: _f(texts, cell))
    texts = near_lines(25, seed)
    random.Random(seed).shuffle(texts)
    docs = ["\n".join(texts[i : i + 5]) for i in range(0, len(texts), 5)]
    got = {(r.doc_id, bytes(r.text_id), r.line_no): (r.class_doc_id, r.class_line_no) for r in lines.line_classes(docs_frame(spark, docs)).collect()}
    assert got == plain_classes(list(enumerate(docs, 1)))


def test_every_matching_pair_meets():
    texts = sorted({x for x in near_lines(60, 7) if len(x) >= 20})
    keys, owners, sketch = lines.bucket_rows(texts)
    by = {}
    for k, o in zip(keys.tolist(), owners.tolist()):
        by.setdefault(k, set()).add(o)
    meet = {(a, b) for g in by.values() for a in g for b in g}
    for i, a in enumerate(texts):
        for j in range(i):
            k = min(2, min(len(a), len(texts[j])) // 20)
            if abs(len(a) - len(texts[j])) <= k and k and distance(a, texts[j]) <= k:
                assert (i, j) in meet and ((int(sketch[i]) ^ int(sketch[j])) & (2**64 - 1)).bit_count() <= 6 * k


def test_dropping_repeated_lines(spark):
    a, b, c = "A first line that is quite long, really long.", "Another line of a similar kind.", "Short."
    near = a.replace("quite", "quitE")
    df = docs_frame(spark, [f"{a}\n{c}\nown words", f"{near}\r\n{b}", f" {b} \n{c}", None, "", f"{a}\n\nnew", "own words"], [1, 2, 3, None, 5, 6, None], clashes=True)
    got = {r.doc_id: r.text for r in lines.drop_repeated(df).collect()}
    assert got == {1: f"{a}\n{c}\nown words", 2: b, 6: "\nnew"}
    assert lines.drop_repeated(df).columns == df.columns


def test_odd_texts_repeated_rows_and_no_rows(spark):
    df = docs_frame(spark, [*ODD, ODD[5]], [None, *range(1, len(ODD)), 6])
    got = lines.line_classes(df)
    assert got.count() == sum(1 for t in [*ODD, ODD[5]] for _ in lines.lines_of(t))
    assert lines.line_classes(df.limit(0)).count() == 0 and lines.drop_repeated(df.limit(0)).count() == 0


def test_lines_with_partners_can_come_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(lines, "LISTED", 0)
    x = "A first line that is quite long, really long."
    df = docs_frame(spark, [x, x.replace("first", "firsT")])
    assert lines.line_classes(df).where("not kept").count() == 1
