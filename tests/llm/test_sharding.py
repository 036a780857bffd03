"""Minimax shards: as small as the best contiguous partition, groups whole, slots gapless."""

import random
import zlib
from itertools import accumulate

import pytest
from helpers import ODD, docs_frame

from strikeline.llm import sharding


def best(sizes, shards):
    """Smallest possible largest sum, by dynamic programming."""
    ends = [0, *accumulate(sizes)]
    row = ends[:]
    for _ in range(shards - 1):
        row = [min(max(row[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return row[-1]


def made(n, seed, giant=False):
    rng = random.Random(seed)
    keys = sorted({rng.randint(-(2**62), 2**62) for _ in range(n)} if seed % 2 else rng.sample(range(10 * n), n))
    return [(k, (n * 40 if giant and i == n // 3 else 0) + rng.randint(1, 50)) for i, k in enumerate(keys)]


@pytest.mark.parametrize(("seed", "giant", "fanout", "most"), [(1, False, 4096, 50_000), (2, False, 16, 5), (3, False, 32, 3), (4, True, 16, 5), (5, True, 64, 20)])
def test_the_largest_shard_is_as_small_as_can_be(spark, seed, giant, fanout, most):
    groups = made(300, seed, giant)
    cuts = sharding.find_cuts(spark.createDataFrame(groups, "key long, size long"), 8, fanout, most)
    sums = [0] * 8
    for k, s in groups:
        sums[sum(c is not None and k >= c for c in cuts)] += s
    assert max(sums) == best([s for _, s in groups], 8)


def test_smallest_capacity_and_even_cuts():
    rng = random.Random(3)
    for _ in range(300):
        sizes, shards = [rng.randint(1, 30) for _ in range(rng.randint(1, 25))], rng.randint(1, 9)
        ends = list(accumulate(sizes))
        c = sharding.smallest_capacity(ends, shards, max(max(sizes), -(-ends[-1] // shards)))
        assert c == best(sizes, shards)
        cuts = sharding.even_cuts(ends, shards, c)
        assert len(cuts) == shards and cuts == sorted(cuts) and cuts[-1] == len(sizes)
        assert all(sum(sizes[a:b]) <= c for a, b in zip([0, *cuts], cuts))


def test_documents(spark):
    rng = random.Random(5)
    texts = [*ODD, *["copy " * 50] * 20, *["w" * rng.randint(0, 400) for _ in range(200)]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = sharding.shard(docs_frame(spark, texts, ids, clashes=True), 8, slot_rows=16).collect()
    assert len(got) == len(texts)
    by = dict(zip(ids, texts))
    sums, slots, where = {}, {}, {}
    for r in got:
        data = (by[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault(data, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(w) == 1 for w in where.values())
    groups = {}
    for i, t in by.items():
        g = groups.setdefault(t or "", [i, 0])
        g[0], g[1] = min(g[0], i), g[1] + len((t or "").encode()) + 1
    assert max(sums.values()) == best([s for _, s in sorted(groups.values())], 8)


def test_null_ids_repeated_rows_few_groups_and_no_rows(spark):
    got = sharding.shard(docs_frame(spark, ["a", "a", "bb", None, ""], [None, 7, 7, 3, None])).collect()
    assert len(got) == 5 and len({r.shard for r in got if r.size == 2}) == 1
    assert sharding.shard(docs_frame(spark, [])).count() == 0
    text_ids = docs_frame(spark, ["a", "b", "c"]).selectExpr("cast(doc_id as string) doc_id", "text")
    assert sharding.shard(text_ids, 2).count() == 3
