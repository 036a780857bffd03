"""SimHash near-duplicates by a generalised pigeonhole.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word shingles.
Two fingerprints link at ``distance`` or fewer differing bits. To find all links:

* correlated bits are put into the same part, so that the parts differ independently;
* parts get thresholds t_i >= -1 with sum(t_i + 1) = distance + 1. A fingerprint within the
  distance must be within t_i on some part, else it would differ in more bits. For each
  fingerprint the thresholds come from dynamic programming over estimated candidate
  counts: a part whose value is common gets a low one (-1: not probed), a rare one more;
* each fingerprint stands in the bucket of every part value, probes the buckets within
  its thresholds, and pairs that meet are verified on all bits.

The number of parts follows from the number of fingerprints: the more there are, the
longer and rarer the part values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.common import fresh, map_rows, ref
from strikeline.llm.links import cells, close_pairs, components, per_cell, thin
from strikeline.plans.tables import settle

BITS = 64
PIECE = 11  # bits of the value histograms
#: Per row that is shuffled to a bucket (2 to 3 microseconds) and per pair that meets there (2 to 20 nanoseconds).
PROBE_COST, CANDIDATE_COST = 1.0, 0.005
CELL = 8192
DENSE, GRAMS = 4096, 512  # fingerprints of a dense group that are compared in a task, with sets of so many shingles
LISTED = 2_000_000  # text keys, 16 MB, up to which linked texts are picked where they are read


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Majority bits of the shingle hashes; zero without words, the whole sequence if it is shorter than a shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(g), seed) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 5, name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint as a long; null text counts as empty. All rows and columns stay."""
    return map_rows(docs, lambda texts: {name: pa.array([fingerprint(t, shingle) for t in texts], pa.int64())}, [T.StructField(name, T.LongType())], text_col)


def bits_of(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(prints: DataFrame) -> np.ndarray:
    """Absolute correlation of every two bits over all fingerprints: 2,080 sums, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = bits_of(b.column(0).to_numpy()).astype(np.float32)
            both += x.T @ x
            n += len(x)
        i, j = np.triu_indices(BITS)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both[i, j].astype(np.int64)), pa.array(np.full(len(i), n, np.int64))], names=["i", "j", "both", "n"])

    rows = prints.select("fp").mapInArrow(run, "i int, j int, both long, n long").groupBy("i", "j").agg(F.sum("both"), F.sum("n")).collect()
    joint, n = np.zeros((BITS, BITS)), max([1, *(r[3] for r in rows)])
    for i, j, k, _ in rows:
        joint[i, j] = joint[j, i] = k / n
    p = np.diag(joint)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((joint - np.outer(p, p)) / np.outer(dev, dev))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """Cut the bits into ``m`` parts of nearly equal width, each grown from its most correlated bits."""
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = len(free) // (m - k)
        left = sorted(free)
        sub = corr[np.ix_(left, left)] - 2 * np.eye(len(left))
        part = [left[int(np.argmax(sub.max(axis=1)))]]
        while len(part) < width:
            rest = [x for x in left if x not in part]
            part.append(rest[int(np.argmax(corr[np.ix_(rest, part)].sum(axis=1)))])
        parts.append(sorted(part))
        free -= set(part)
    return parts


def best_split(widths: list[int], costs: list[np.ndarray], distance: int) -> np.ndarray:
    """Thresholds per row and part with sum(t + 1) = distance + 1 and the least total cost.

    ``costs[i]``: an array rows x (distance + 1), the cost of threshold t on part i; -1 is free.
    """
    n, whole = len(costs[0]), distance + 1
    best = np.full((n, whole + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for i, c in enumerate(costs):
        option = np.full((n, whole + 1, whole + 1), np.inf)
        for units in range(min(whole, widths[i] + 1) + 1):
            cost = c[:, units - 1] if units else 0.0
            option[:, units:, units] = best[:, : whole + 1 - units] + (cost[:, None] if units else 0.0)
        picks.append(option.argmin(axis=2))
        best = option.min(axis=2)
    left, out = np.full(n, whole), np.zeros((n, len(costs)), np.int64)
    for i in range(len(costs) - 1, -1, -1):
        units = picks[i][np.arange(n), left]
        out[:, i] = units - 1
        left = left - units
    return out


def choose_parts(n: int, distance: int) -> int:
    """The number of parts with the least cost if bits were independent."""

    def cost(m: int) -> float:
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        c = [np.array([[PROBE_COST * balls(w, t) + CANDIDATE_COST * n * balls(w, t) / 2.0**w for t in range(distance + 1)]]) for w in widths]
        t = best_split(widths, c, distance)[0]
        return sum(c[i][0, t[i]] for i in range(m) if t[i] >= 0)

    return min(range(2, distance + 2), key=cost) if distance else 2


def balls(width: int, t: int) -> int:
    return sum(comb(width, e) for e in range(t + 1))


class Plan:
    """The parts, and how common their values are: constant size, whatever the input."""

    def __init__(self, parts: list[list[int]], distance: int, n: int) -> None:
        self.parts, self.distance, self.n = parts, distance, n
        self.widths = [len(p) for p in parts]
        self.pieces = [[list(x) for x in np.array_split(np.arange(w), -(-w // PIECE))] for w in self.widths]
        self.near: dict[tuple[int, int], np.ndarray] = {}

    def values(self, prints: np.ndarray) -> list[np.ndarray]:
        """The value of each part."""
        bits = bits_of(prints).astype(np.uint64)
        return [(bits[:, p] << np.arange(len(p), dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.int64) for p in self.parts]

    def piece_values(self, values: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        for i, pieces in enumerate(self.pieces):
            for k, p in enumerate(pieces):
                yield i, k, (values[i] >> p[0]) & ((1 << len(p)) - 1)

    def learn(self, counts: dict[tuple[int, int], np.ndarray]) -> None:
        """From histograms: the share of fingerprints at each distance from each piece value."""
        for (i, k), h in counts.items():
            width, v = len(self.pieces[i][k]), np.arange(len(h))
            share = [sum(h[v ^ sum(1 << x for x in c)] for c in combinations(range(width), e)) for e in range(min(width, self.distance) + 1)]
            share += [np.zeros(len(h))] * (self.distance + 1 - len(share))
            self.near[i, k] = np.stack(share, axis=1) / max(1, self.n)

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        costs = []
        for i, pieces in enumerate(self.pieces):
            total = np.zeros((len(values[i]), self.distance + 1))
            total[:, 0] = 1
            for k, p in enumerate(pieces):
                d = self.near[i, k][(values[i] >> p[0]) & ((1 << len(p)) - 1)]
                total = np.stack([sum(total[:, a] * d[:, e - a] for a in range(e + 1)) for e in range(self.distance + 1)], axis=1)
            probes = np.array([balls(self.widths[i], t) for t in range(self.distance + 1)])
            costs.append(PROBE_COST * probes + CANDIDATE_COST * self.n * np.cumsum(total, axis=1))
        return best_split(self.widths, costs, self.distance)

    def probes(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket keys with the fingerprints that stand in them (True) or probe them (False).

        Every fingerprint stands in the bucket of each of its values, and so meets those that probe it;
        what it probes at distance zero is the bucket it stands in.
        """
        values = self.values(prints)
        limits = self.thresholds(values)
        keys, owners, own = [], [], []
        for i, w in enumerate(self.widths):
            keys.append(values[i] | (i << 40))
            owners.append(prints)
            own.append(np.ones(len(prints), bool))
            for t in range(1, self.distance + 1):
                who = limits[:, i] >= t
                if who.any():
                    masks = np.array([sum(1 << x for x in c) for c in combinations(range(w), t)], np.int64)
                    keys.append(((values[i][who, None] ^ masks) | (i << 40)).ravel())
                    owners.append(np.repeat(prints[who], len(masks)))
                    own.append(np.zeros(len(owners[-1]), bool))
        return np.concatenate(keys), np.concatenate(owners), np.concatenate(own)


    def first_meeting(self, part: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two fingerprints that meet in a bucket of ``part`` do not already meet in one of an earlier part."""
        prints, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        values = self.values(prints)
        limits = self.thresholds(values)
        x, y = at[: len(a)], at[len(a) :]
        new = np.ones(len(a), bool)
        for i, v in enumerate(values):
            apart = np.bitwise_count(v[x] ^ v[y])
            new &= (part <= i) | ((apart > 0) & (apart > np.maximum(limits[x, i], limits[y, i])))
        return new


def plan_for(prints: DataFrame, distance: int) -> Plan:
    n = prints.count()
    plan = Plan(group_bits(correlations(prints), choose_parts(n, distance)), distance, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, k, v in plan.piece_values(plan.values(b.column(0).to_numpy())):
                sums[i, k] = sums.get((i, k), 0) + np.bincount(v, minlength=1 << len(plan.pieces[i][k]))
        for (i, k), h in sums.items():
            v = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i), pa.int32()), pa.array(np.full(len(v), k), pa.int32()), pa.array(v, pa.int32()), pa.array(h[v], pa.int64())], names=["i", "k", "v", "n"])

    counts = {(i, k): np.zeros(1 << len(p)) for i, pieces in enumerate(plan.pieces) for k, p in enumerate(pieces)}
    rows = prints.select("fp").mapInArrow(run, "i int, k int, v int, n long").groupBy("i", "k", "v").agg(F.sum("n").alias("n"))
    for i, k, v, c in rows.collect():  # at most 2 ** PIECE values for each piece
        counts[i, k][v] = c
    plan.learn(counts)
    return plan


def links_within(prints: DataFrame, distance: int, cell: int = CELL) -> DataFrame:
    """``a, b``: links between the distinct values of column ``fp``: enough that whatever is connected by
    links is connected by these; in buckets of few rows, every link."""
    return marked_links(prints, distance, cell).select("a", "b").distinct()


def marked_links(prints: DataFrame, distance: int, cell: int = CELL) -> DataFrame:
    """``a, b, dense``: as ``links_within``. Every link is either given, or its ends are connected by the dense ones."""
    plan = plan_for(prints, distance)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy()
            for s in range(0, len(x), 2048):
                keys, owners, own = plan.probes(x[s : s + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners), pa.array(own)], names=["key", "fp", "own"])

    def verify(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        x = b.column(1).to_numpy()
        # bits of a signed number would be counted without its sign
        u = x.view(np.uint64)
        left, right, dense = close_pairs(starts, u, b.column(2).to_numpy(zero_copy_only=False), distance)
        if len(left):
            # of pairs that stand for others, none may go
            new = dense | plan.first_meeting(b.column(0).to_numpy()[left] >> 40, x[left], x[right])
            left, right, dense = thin(left[new], right[new], dense[new], u, starts)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x[left], x[right])), pa.array(np.maximum(x[left], x[right])), pa.array(dense)], names=["a", "b", "dense"])

    rows = prints.select("fp").mapInArrow(probe, "key long, fp long, own boolean")
    found = per_cell(cells(rows, "key", "fp", cell).select("key", "fp", "own", "cell"), "key", verify, "a long, b long, dense boolean")
    return found.where("a != b").groupBy("a", "b").agg(F.max("dense").alias("dense"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 4) -> DataFrame:
    """``doc_id, fp, component_id``: every document with its fingerprint (long) and the smallest id it is linked with.

    Null or empty text has fingerprint zero and links like any other. Equal fingerprints
    are one node, however many documents share it. Null ids are kept and never become a component's
    id unless it has no other. Repeated rows stay. Other columns are not read. Without rows: empty.
    """
    fp = "fp"
    rows = settle(with_fingerprint(docs.select(ref(id_col).alias("doc_id"), ref(text_col).cast("string").alias("text")), "text", shingle, fp).select("doc_id", fp), "prints")
    return rows.join(roots(rows, distance), fp).select("doc_id", fp, "component_id")


def roots(rows: DataFrame, distance: int, links: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``fp, component_id`` for the distinct fingerprints of ``rows(doc_id, fp)``; ``links`` may replace the links
    that it is given as those of ``marked_links``."""
    prints = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
    found = components(links(marked_links(prints, distance)) if links else links_within(prints, distance), "a", "b")
    node = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = node.where("root != fp").groupBy("root").agg(F.min("first").alias("other"))
    near = node.select("fp", "root", "first").join(least.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root"), "left")
    own = node.where("root = fp").select(F.col("fp").alias("_fp"), F.col("first").alias("root_first"))
    near = near.join(own, F.col("root") == F.col("_fp"), "left")
    return near.select("fp", F.least("root_first", "other").alias("component_id"))


def text_key(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) - 2**63


def with_text_key(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    return map_rows(docs, lambda texts: {name: pa.array([text_key(t) for t in texts], pa.int64())}, [T.StructField(name, T.LongType())], text_col)


def shingle_sets(named: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``named(fp, text_key)`` with ``grams``: the sorted hashes of the distinct shingles of each text.

    Texts are read again only to pick the named ones: where they are read while the keys fit in a bounded list,
    else by a join.
    """
    named = settle(named, "named")
    n = named.count()
    wanted = np.sort(named.select("text_key").toArrow().column(0).to_numpy()) if n <= LISTED else None
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, digest, join = shared.value, xxhash.xxh64_intdigest, b" ".join
        for b in batches:
            keys, out = [], []
            for text in b.column(0).to_pylist():
                k = text_key(text)
                if wanted is None or (len(wanted) and wanted[min(np.searchsorted(wanted, k), len(wanted) - 1)] == k):
                    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
                    keys.append(k)
                    out.append(np.unique(np.fromiter((digest(join(g)) for g in grams), np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["text_key", "grams"])

    known = texts.mapInArrow(sets, "text_key long, grams binary")
    return named.join(known.dropDuplicates(["text_key"]), "text_key").select("fp", "text_key", "grams")


def similar_links(found: DataFrame, rows: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The links whose texts share at least ``least`` of their distinct shingles; a fingerprint stands for its text
    of the smallest ``text_key``."""
    found = settle(found, "candidates")
    ends = found.select(F.col("a").alias("fp")).unionByName(found.select(F.col("b").alias("fp"))).distinct()
    known = shingle_sets(rows.join(ends, "fp").groupBy("fp").agg(F.min("text_key").alias("text_key")), texts, shingle)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = found.join(known.select(F.col("fp").alias("a"), F.col("grams").alias("x")), "a").join(known.select(F.col("fp").alias("b"), F.col("grams").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def all_similar_links(marked: DataFrame, rows: DataFrame, texts: DataFrame, shingle: int, least: float, distance: int, most: int = DENSE) -> DataFrame:
    """``a, b``: links that connect whatever is connected by links within ``distance`` whose texts are similar.

    The given links are verified first, one text for each fingerprint. Where dense ones stand for links that are not
    given, or a fingerprint has several texts, the fingerprints so connected come together with all their shingle
    sets, and every two of them within the distance are compared that are not connected yet; of the similar ones,
    those stay that connect more.
    """
    several = rows.groupBy("fp").agg(F.min("text_key").alias("_low"), F.max("text_key").alias("_high")).where("_low != _high")
    several = settle(several.select("fp", F.lit(True).alias("several")), "several")
    marked = settle(marked, "marked")
    for end in ("a", "b"):
        marked = marked.join(several.withColumnRenamed("fp", end), end, "left").withColumn("dense", F.col("dense") | F.coalesce("several", F.lit(False))).drop("several")
    marked = settle(marked, "marked")
    links = settle(similar_links(marked.select("a", "b"), rows, texts, shingle, least), "similar")
    if marked.where("dense").isEmpty():
        return links
    dense = components(marked.where("dense").select("a", "b"), "a", "b").withColumnRenamed("node", "fp").withColumnRenamed("root", "block")
    labels = components(links, "a", "b").withColumnRenamed("node", "fp").withColumnRenamed("root", "label")
    dense = settle(dense.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "dense")
    split = settle(dense.groupBy("block").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low != _high").select("block"), "split")
    open_rows = settle(dense.join(split, "block"), "open")
    if open_rows.isEmpty():
        return links
    sets = shingle_sets(rows.join(open_rows.select("fp"), "fp").select("fp", "text_key").distinct(), texts, shingle)
    sets = sets.withColumn("set", F.xxhash64("grams")).groupBy("fp", "set").agg(F.first("grams").alias("grams"))
    members = settle(open_rows.join(sets, "fp").select("block", "fp", "label", "set", "grams"), "members")
    # a long set counts as several rows, so that the cells are bounded in bytes
    counted = members.groupBy("block").agg(F.ceil(F.sum(F.greatest(F.lit(1.0), F.length("grams") / (8 * GRAMS)))).alias("_n"))

    def verify(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        x, label, ends = b.column(1).to_numpy(), b.column(2).to_numpy(), np.r_[starts[1:], b.num_rows]
        left, right = [], []
        for s, e in zip(starts.tolist(), ends.tolist()):
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(3).slice(s, e - s)]
            i, j = similar_forest(x[s:e].view(np.uint64), label[s:e], sets, distance, least)
            left.append(x[s:e][i])
            right.append(x[s:e][j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64())], names=["a", "b"])

    more = per_cell(cells(members, "block", "set", most, counted).select("block", "fp", "label", "grams", "cell"), "block", verify, "a long, b long")
    return links.unionByName(more.distinct())


def similar_forest(values: np.ndarray, label: np.ndarray, sets: list[np.ndarray], distance: int, least: float) -> tuple[list[int], list[int]]:
    """Similar pairs within the distance that connect rows of different ``label``, found without listing all pairs."""
    left, right, size = [], [], np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at, label, has = np.r_[0, np.cumsum(size)], np.unique(label, return_inverse=True)[1], np.zeros(int(ids.max(initial=0)) + 1, bool)
    for i in range(len(values) - 1):
        rest = slice(i + 1, len(values))
        ok = (label[rest] != label[i]) & (np.bitwise_count(values[rest] ^ values[i]) <= distance)
        ok &= np.minimum(size[rest], size[i]) >= least * np.maximum(size[rest], size[i])
        near = np.flatnonzero(ok) + i + 1
        if not len(near):
            continue
        mine = ids[at[i] : at[i + 1]]
        has[mine] = True
        for k in range(0, len(near), 1024):
            part = near[k : k + 1024]
            start = np.r_[0, np.cumsum(size[part])]
            both = np.add.reduceat(has[ids[np.repeat(at[part] - start[:-1], size[part]) + np.arange(start[-1])]], start[:-1], dtype=np.int64)
            for j in part[both >= least * (size[part] + size[i] - both)].tolist():
                if label[i] != label[j]:
                    left.append(i)
                    right.append(j)
                    label[label == label[j]] = label[i]
        has[mine] = False
    return left, right


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 12, least: float = 0.8) -> DataFrame:
    """One document of each group: that with the smallest id (null ids last); columns as given.

    Documents with equal fingerprints are one group. Other links are pairs within ``distance`` bits, far enough for
    most pairs of the similarity asked for, whose texts share at least ``least`` of their distinct shingles. Where rows
    share the smallest id, one of them stays. Null text is empty.
    """
    key, doc, other, n = fresh(docs, "text_key", "first_id", "first_key", "n_same")
    texts = docs.select(ref(text_col).cast("string").alias("text"))
    both = [T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())]
    rows = docs.select(ref(id_col).alias("doc_id"), ref(text_col).cast("string").alias("text"))
    rows = map_rows(rows, lambda x: {"text_key": pa.array([text_key(t) for t in x], pa.int64()), "fp": pa.array([fingerprint(t, shingle) for t in x], pa.int64())}, both, "text")
    rows = settle(rows.select("doc_id", "text_key", "fp"), "prints")
    found = roots(rows, distance, lambda links: all_similar_links(links, rows, texts, shingle, least, distance))
    labelled = rows.join(found, "fp").withColumn("group", F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp"))))
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = labelled.where(same).groupBy("doc_id", "group").agg(F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("n"))
    first = settle(first.select(F.col("doc_id").alias(doc), F.col("text_key").alias(other), F.col("n").alias(n)), "firsts")
    kept = with_text_key(docs, text_col, key).join(first, ref(id_col).eqNullSafe(ref(doc)) & (ref(key) == ref(other)))
    one = kept.where(ref(n) == 1)
    if not first.where(ref(n) > 1).isEmpty():
        one = one.unionByName(kept.where(ref(n) > 1).dropDuplicates([key, id_col]))
    return one.select(*[ref(c) for c in docs.columns])
