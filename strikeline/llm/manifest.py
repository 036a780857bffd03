"""Merkle manifest of a table: leaf places by bitmap ranks, tree levels in slot arrays.

Leaves of a group stand in the order of their ids. Their places come without sorting
rows: the ids of a group are a bitmap of 64-bit words, of which only words with a bit
exist, merged by OR in partial aggregates. Popcounts of words are summed to counts of
2^16, 2^32 and 2^48 ids; prefix sums over the at most 65,536 children of one node are the
rank directories, and a leaf's place is the directory base of its word and the
bits below its own. Ids that occur several times are ranked among themselves by leaf
digest, equal leaves by row, in slices.

Levels are reduced in blocks of at most 1,024 neighbours: each leaf goes to the slot that its
place names in the array of its block, one task step hashes ten levels, and the block's
top is a leaf of the next tier. No array grows with a group: a group of 10^9 leaves is
three tiers. Proof paths come down the same arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.common import ref
from strikeline.operators.slicing import exclusive_prefix, null_safe_join, row_index
from strikeline.plans.tables import settle

BLOCK = 1024  # slots of an array at most
DIRECTORY = (16, 32, 48)  # id bits below the nodes of each directory


def encoded(c: Column) -> Column:
    """A value for hashing: byte count, colon, value; a dash where it is null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """The digest of a row as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in fields]), 256))


def _below(low: Column) -> Column:
    """A mask of the bits under a place."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), low))


def rank_index(leaves: DataFrame) -> DataFrame:
    """``grp, word, bits, n, base``: the bitmap words of each group and the number of its leaves in front of each word.

    ``n`` counts rows, more than the bits where ids repeat. Leaves without an id come first.
    """
    words = leaves.where("id IS NOT NULL").groupBy("grp", F.shiftright("id", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(63).cast("int"))).alias("bits"), F.count(F.lit(1)).alias("n"))
    words = settle(words, "words")
    nodes, tables = words.select("grp", F.shiftright("word", DIRECTORY[0] - 6).alias("node"), "n"), []
    for k, bits in enumerate(DIRECTORY):
        nodes = nodes.groupBy("grp", "node").agg(F.sum("n").alias("n"))
        tables.append(nodes)
        if k + 1 < len(DIRECTORY):
            nodes = nodes.select("grp", F.shiftright("node", DIRECTORY[k + 1] - bits).alias("node"), "n")
    nulls = leaves.where("id IS NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("_nulls"))
    top = null_safe_join(_with_base(tables[-1], "node", []), nulls, ["grp"])
    index = top.select("grp", "node", (F.col("base") + F.coalesce("_nulls", F.lit(0))).alias("base"))
    for k in range(len(DIRECTORY) - 2, -1, -1):
        index = _under(_with_base(tables[k].withColumn("up", F.shiftright("node", DIRECTORY[k + 1] - DIRECTORY[k])), "node", ["up"]), index).drop("n")
    words = words.withColumn("up", F.shiftright("word", DIRECTORY[0] - 6))
    return _under(_with_base(words, "word", ["up"]), index)


def _with_base(nodes: DataFrame, key: str, parent: list[str]) -> DataFrame:
    """Leaves in front of each node among the children of its parent: at most 65,536 rows a window."""
    before = W.partitionBy("grp", *parent).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return nodes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _under(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Add the base of each node's parent to its own."""
    parents = index.select("grp", F.col("node").alias("up"), F.col("base").alias("_over"))
    return null_safe_join(nodes, parents, ["grp", "up"]).withColumn("base", F.col("base") + F.col("_over")).drop("_over", "up")


def with_place(leaves: DataFrame) -> DataFrame:
    """Add ``place``, from 0 without gaps within each group, to ``no, grp, id, leaf``.

    Order: null ids, then ids ascending; rows of one id by digest, equal digests by ``no`` (a number
    of the row that names its partition from bit 33 on, as ``monotonically_increasing_id`` does).
    """
    index = settle(rank_index(leaves), "ranks")
    low = F.col("id").bitwiseAND(63).cast("int")
    repeats = index.where(F.col("n") > F.bit_count("bits"))
    several = not repeats.isEmpty()
    ties = leaves.where("id IS NULL").select("no", "grp", "id", "leaf")
    index = index.withColumn("more", F.lit(None).cast("array<struct<low:int,k:bigint>>"))
    if several:
        held = null_safe_join(leaves.where("id IS NOT NULL").withColumn("word", F.shiftright("id", 6)), repeats.select("grp", "word", F.lit(True).alias("_held")), ["grp", "word"]).where("_held")
        copies = settle(held.groupBy("grp", "id").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "copies")
        more = copies.groupBy("grp", F.shiftright("id", 6).alias("word")).agg(F.collect_list(F.struct(low.alias("low"), (F.col("k") - 1).alias("k"))).alias("more"))
        index = null_safe_join(index.drop("more"), more, ["grp", "word"])
        ties = ties.unionByName(null_safe_join(held, copies, ["grp", "id"]).where("k IS NOT NULL").select("no", "grp", "id", "leaf"))
    found = null_safe_join(leaves.withColumn("word", F.shiftright("id", 6)), index.select("grp", "word", "bits", "base", "more"), ["grp", "word"])
    extra = F.aggregate(F.filter(F.coalesce("more", F.array().cast("array<struct<low:int,k:bigint>>")), lambda x: x["low"] < low), F.lit(0).cast("long"), lambda a, x: a + x["k"])
    place = F.coalesce(F.col("base") + F.bit_count(F.col("bits").bitwiseAND(_below(low))) + extra, F.lit(0))
    found = found.withColumn("place", place).drop("word", "bits", "base", "more")
    if not several and ties.isEmpty():
        return found
    ties = settle(ties, "ties")
    digests = ties.groupBy("grp", "id", "leaf").agg(F.count(F.lit(1)).alias("k")).withColumn("_slice", F.conv(F.substring(F.hex("leaf"), 1, 3), 16, 10).cast("long"))
    first = exclusive_prefix(digests, ["grp", "id"], ["leaf"], {"_first": "k"}).select("grp", "id", "leaf", "_first")
    within = row_index(ties.withColumn("_slice", F.shiftright("no", 33)), ["grp", "id", "leaf"], ["no"], out="_within").drop("_slice")
    rank = null_safe_join(within, first, ["grp", "id", "leaf"]).select("no", (F.col("_first") + F.col("_within")).alias("_tie"))
    return found.join(rank, "no", "left").withColumn("place", F.col("place") + F.coalesce("_tie", F.lit(0))).drop("_tie")


def node(children: Sequence[bytes]) -> bytes:
    """The digest over the hex digits of the children's digests."""
    return sha256("".join([c.hex() for c in children]).encode()).digest()


def levels(nodes: list[bytes], arity: int, most: int | None) -> list[list[bytes]]:
    """The nodes and what they reduce to, level by level: ``most`` levels, or down to one node."""
    out = [nodes]
    while len(out) <= most if most is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([node(last[i : i + arity]) for i in range(0, len(last), arity)])
    return out


def paths(all_levels: list[list[bytes]], arity: int) -> list[bytes]:
    """For every node of the lowest level, level by level: its place in its run, the number of others, the others."""
    below = [b""] * len(all_levels[-1])
    for row in reversed(all_levels[:-1]):
        out = []
        for i in range(len(row)):
            start, at = i - i % arity, i % arity
            others = row[start:i] + row[i + 1 : start + arity]
            out.append(bytes((at, len(others))) + b"".join(others) + below[i // arity])
        below = out
    return below


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Place in the run and the others, from the leaf up."""
    pos = 0
    while pos < len(path):
        at, n = path[pos], path[pos + 1]
        pos += 2
        yield at, [path[pos + 32 * k : pos + 32 * (k + 1)] for k in range(n)]
        pos += 32 * n


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for at, others in steps(path):
        leaf = node([*others[:at], leaf, *others[at:]])
    return leaf


class Tree:
    """Slot arrays of the tiers of one forest: a tree for every group."""

    def __init__(self, nodes: DataFrame, arity: int, carried: Sequence[str]) -> None:
        """``nodes``: ``grp, place, leaf`` and the carried columns, places gapless from 0 in each group."""
        self.arity, self.span, self.deep = arity, arity, 1
        while self.span * arity <= BLOCK:
            self.span, self.deep = self.span * arity, self.deep + 1
        self.tiers: list[DataFrame] = []
        self.carried = list(carried)
        extra = self.carried
        while True:
            arrays = settle(self._arrays(nodes, extra), "slots")
            self.tiers.append(arrays)
            nodes, extra = self._tops(arrays), []
            if (arrays.agg(F.max("block")).first()[0] or 0) == 0:
                break
        self.roots = nodes.select("grp", F.col("leaf").alias("subroot"))

    def _arrays(self, nodes: DataFrame, extra: Sequence[str]) -> DataFrame:
        slot = F.struct((F.col("place") % self.span).cast("int").alias("slot"), "leaf", *extra)
        return nodes.groupBy("grp", F.floor(F.col("place") / self.span).cast("long").alias("block")).agg(F.collect_list(slot).alias("slots"))

    def _reduced(self) -> object:
        span, deep, arity = self.span, self.deep, self.arity

        def reduce(block: int, slots: pa.StructArray) -> tuple[list[int], list[list[bytes]]]:
            at, leaves = slots.field("slot").to_pylist(), slots.field("leaf").to_pylist()
            row: list[bytes] = [b""] * len(at)
            for i, leaf in zip(at, leaves):
                row[i] = leaf
            return at, levels(row, arity, deep if block or len(row) == span else None)

        return reduce

    def _tops(self, arrays: DataFrame) -> DataFrame:
        reduce = self._reduced()
        schema = T.StructType([arrays.schema["grp"], T.StructField("place", T.LongType()), T.StructField("leaf", T.BinaryType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                slots = b.column(2)
                tops = [reduce(block, slots[i].values)[1][-1][0] for i, block in enumerate(b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tops, pa.binary())], names=schema.names)

        return arrays.select("grp", "block", "slots").mapInArrow(run, schema)

    def descend(self, above: DataFrame) -> DataFrame:
        """Every lowest node with its carried columns, ``place, path``, and the columns of its group in ``above``.

        ``above`` has ``grp, path`` and one row a group: the path of the group's root, by which all paths go on.
        """
        passed = [c for c in above.columns if c not in ("grp", "path")]
        rows = above.withColumn("place", F.lit(0).cast("long"))
        for tier in range(len(self.tiers) - 1, -1, -1):
            extra = self.carried if tier == 0 else []
            arrays = null_safe_join(self.tiers[tier], rows.withColumnRenamed("place", "block"), ["grp", "block"])
            rows = self._spread(arrays.select("grp", "block", "slots", "path", *passed), extra, passed)
            if tier:
                rows = settle(rows, "paths")
        return rows

    def _spread(self, arrays: DataFrame, extra: Sequence[str], passed: Sequence[str]) -> DataFrame:
        reduce, arity, span = self._reduced(), self.arity, self.span
        slot = {f.name: f for f in arrays.schema["slots"].dataType.elementType.fields}
        own = ["leaf", *extra] if extra else []
        fields = [arrays.schema["grp"], T.StructField("place", T.LongType()), *[slot[c] for c in own], T.StructField("path", T.BinaryType()), *[arrays.schema[c] for c in passed]]
        schema = T.StructType(fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, (block, up) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist())):
                    slots = b.column(2)[i].values
                    at, all_levels = reduce(block, slots)
                    found = paths(all_levels, arity)
                    same = pa.array([i] * len(at), pa.int32())
                    cols = [b.column(0).take(same), pa.array([block * span + k for k in at], pa.int64()), *[slots.field(c) for c in own], pa.array([found[k] + up for k in at], pa.binary()), *[b.column(4 + k).take(same) for k in range(len(passed))]]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

        return arrays.mapInArrow(run, schema)


def manifest(docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id", group_col: str = "lang", arity: int = 2, changed: Sequence[Column] | None = None) -> DataFrame:
    """``doc_id, grp, place, leaf, changed, path, subroot, root``: one row per row of ``docs``, digests as bytes.

    A leaf is the digest of ``fields`` in their order. Per group, leaves ascend by id; every
    ``arity`` neighbours become one node (the last run may be shorter, even one) until one is left,
    the subroot; subroots in the order of their groups become the root likewise. ``path`` is the proof
    of a leaf: ``steps(path)`` gives its runs up to the root. ``changed`` states fields of a second
    leaf to carry along (null where it does not differ).

    Null fields are a dash; a null group is a group, before all others, which go by their bytes; null
    ids come first in their group. Rows of one id go by leaf digest; of equal rows each is a leaf.
    Ids are integers. Columns not named are not read. Without rows the result is empty.
    """
    if not 2 <= arity <= 255:
        raise ValueError("arity must lie between 2 and 255")
    leaf = leaf_digest([ref(c) for c in fields])
    other = F.lit(None).cast("binary") if changed is None else leaf_digest(changed)
    leaves = docs.select(F.monotonically_increasing_id().alias("no"), ref(group_col).alias("grp"), ref(id_col).cast("long").alias("id"), leaf.alias("leaf"), other.alias("changed"))
    leaves = settle(leaves.withColumn("changed", F.when(F.col("changed") != F.col("leaf"), F.col("changed"))), "leaves")
    groups = Tree(with_place(leaves).drop("no"), arity, ["id", "changed"])
    ordered = settle(groups.roots.orderBy("grp").withColumn("no", F.monotonically_increasing_id()), "subroots")
    part = F.shiftright("no", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = ordered.withColumn("part", part).join(starts, "part").withColumn("place", F.col("start") + F.col("no").bitwiseAND((1 << 33) - 1))
    top = Tree(placed.select(F.lit(0).alias("grp"), "place", F.col("subroot").alias("leaf"), F.col("grp").alias("name")), arity, ["name"])
    root = top.roots.select("grp", F.lit(b"").alias("path"), F.col("subroot").alias("root"))
    above = top.descend(root).select(F.col("name").alias("grp"), "path", F.col("leaf").alias("subroot"), "root")
    return groups.descend(settle(above, "above")).withColumnRenamed("id", "doc_id")


def with_folds(rows: DataFrame, leaf: Column) -> DataFrame:
    """Add ``proof`` (digest over the hex digits of the path's others, from the leaf up) and ``folded`` (the root that ``leaf`` leads to)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("proof", T.BinaryType()), T.StructField("folded", T.BinaryType())])
    names = rows.columns
    at = names.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            proofs, folds = [], []
            for path, start in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                proofs.append(node([x for _, others in steps(path) for x in others]))
                folds.append(fold(start, path))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(proofs, pa.binary()), pa.array(folds, pa.binary())], names=schema.names)

    return rows.select("*", leaf.alias("_start")).mapInArrow(run, schema)
