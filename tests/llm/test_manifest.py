"""The Merkle manifest against a tree built in plain Python."""

from hashlib import sha256

import pytest
from helpers import ODD, docs_frame
from pyspark.sql import functions as F

from strikeline.llm import manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(s):
    return sha256(s.encode()).hexdigest()


def plain(rows, arity=2):
    """Rows of (doc_id, source, lang, n_chars, text) to sorted (doc_id, lang, place, leaf, subroot, root, others on the path)."""

    def leaf(r):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        paths, up = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, at in enumerate(up):
                run = range(at - at % arity, min(at - at % arity + arity, len(nodes)))
                paths[i] += [nodes[k] for k in run if k != at]
                up[i] = at // arity
            nodes = [digest("".join(nodes[k : k + arity])) for k in range(0, len(nodes), arity)]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, tops = tree([trees[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, x in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            out.append((x[3][0], g, i, x[2], trees[g][0], root, [*trees[g][1][i], *tops[k]]))
    return sorted(out, key=str)


def found(df, **kw):
    rows = manifest.with_folds(manifest.manifest(df, FIELDS, **kw), F.col("leaf")).collect()
    assert all(r.folded == r.root for r in rows)
    got = []
    for r in rows:
        others = [x.hex() for _, run in manifest.steps(r.path) for x in run]
        assert r.proof.hex() == digest("".join(others))
        got.append((r.doc_id, r.grp, r.place, r.leaf.hex(), r.subroot.hex(), r.root.hex(), others))
    return sorted(got, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("arity,block", [(2, 1024), (2, 4), (3, 9), (7, 8)])
def test_places_roots_and_paths(spark, monkeypatch, arity, block):
    monkeypatch.setattr(manifest, "BLOCK", block)
    ids = [0, 1, 2, 3, 63, 64, 65, -1, -64, -65, 2**16, 2**16 - 1, 2**32 + 5, -(2**40), 2**62, -(2**63), 2**63 - 1, *range(1000, 1040)]
    rows = [(i, f"s{i % 3}", ["de", "en", None, "é", "z"][k % 5] if k % 4 else "en", None if k % 6 == 0 else k, None if k % 7 == 0 else f"text {k}") for k, i in enumerate(ids)]
    assert found(frame(spark, rows), arity=arity) == plain(rows, arity)


def test_repeated_ids_null_ids_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK", 8)
    rows = [(5, "s", "en", k, f"t{k % 9}") for k in range(40)] + [(None, "s", "en", 1, f"n{k % 4}") for k in range(30)] + [(7, "s", "en", 1, "same")] * 50
    rows += [(k, "s", "en", 1, "x") for k in range(20)] + [(None, None, None, None, None)] * 5 + [(7, "s", None, 1, "same")] * 3
    assert found(frame(spark, rows).repartition(5)) == plain(rows)


def test_odd_texts_clashing_names_one_row_and_none(spark):
    df = docs_frame(spark, [*ODD, "z" * 2_000_000], clashes=True).withColumns({"no": F.lit(1), "grp": F.lit("g"), "place": F.lit(2), "leaf": F.lit("l")})
    rows = [tuple(r) for r in df.select(*FIELDS).collect()]
    assert found(df) == plain(rows)
    assert found(df.limit(1)) == plain(rows[:1])
    assert manifest.manifest(df.limit(0), FIELDS).count() == 0


def test_a_changed_field_breaks_the_proof_of_its_row_only(spark):
    rows = [(i, "s", "en", i, "t") for i in range(9)]
    df = frame(spark, rows)
    changed = [F.when(F.col("doc_id") == 4, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in FIELDS]
    x = manifest.manifest(df, FIELDS, changed=changed)
    got = manifest.with_folds(x, F.coalesce("changed", "leaf")).collect()
    assert {r.doc_id: r.folded == r.root for r in got} == {i: i != 4 for i in range(9)}


def test_many_groups_of_few_leaves(spark):
    rows = [(i, "s", f"g{i % 150:03d}", i, "t") for i in range(400)]
    assert found(frame(spark, rows)) == plain(rows)


def test_ids_are_ranked_without_sorting_rows(spark):
    """No sort over the leaves: windows only over the nodes of directories."""
    x = manifest.rank_index(spark.range(5000).select(F.lit("a").alias("grp"), (F.col("id") * 3).alias("id")))
    got = {r.word: (r.base, r.n) for r in x.collect()}
    want, seen = {}, 0
    for w in range(5000 * 3 // 64 + 1):
        n = sum(1 for i in range(w * 64, w * 64 + 64) if i % 3 == 0 and i < 15000)
        if n:
            want[w] = (seen, n)
            seen += n
    assert got == want
