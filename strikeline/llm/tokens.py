"""Token counts from distinct pre-tokens.

No piece of the vocabulary goes on from a letter into a space, so merges never cross
from a letter to the space behind it: a text is a sequence of independent
pre-tokens (the spaces before a word, and the word). Each distinct pre-token of the
corpus is encoded once, and a document's count is the sum over its pre-token
frequencies. No ids are kept.

The join of frequencies and piece counts is split by frequency. The most frequent
pre-tokens, at most ``head`` of at most 64 characters each, are looked up where the
text is read; the others, few and rare, are joined by a shuffle. So no key is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.common import ref, text_of
from strikeline.plans.tables import settle

HELD = 250_000  # distinct pre-tokens counted in a task before they are sent on


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space (the text itself gets one in front)."""
    if not text:
        return []
    parts = text.replace("▁", " ").split(" ")
    if "" not in parts:
        return parts
    out, extra = [], 0
    for p in parts:
        if p:
            out.append(" " * extra + p)
            extra = 0
        else:
            extra += 1
    if extra:
        out.append(" " * (extra - 1))
    return out


@lru_cache(maxsize=2)
def piece_counter(model: str):  # noqa: ANN201
    """A function from pre-tokens to their numbers of pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    lone = sp.encode("a b"), sp.encode("a"), sp.encode("  a")
    if any("▁" in p.lstrip("▁") for p in pieces) or len(lone[0]) <= len(lone[1]) or sp.decode(lone[2]) != "  a" or sp.encode("ﬁ") == sp.encode("fi"):
        raise ValueError("this vocabulary has pieces that span words or changes the text: pre-tokens do not stand alone")
    blank = len(sp.encode("a ")) - len(lone[1])
    return lambda units: [len(x) if u else blank for u, x in zip(units, sp.encode(units, num_threads=1))]


def distinct_pretokens(docs: DataFrame, text_col: str) -> DataFrame:
    """``unit, n``: distinct pre-tokens with their numbers of places, counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(pretokens(text))
                if len(counts) > HELD:
                    yield batch(counts)
                    counts = Counter()
        if counts:
            yield batch(counts)

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["unit", "n"])

    return docs.select(text_of(text_col).alias("text")).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def piece_lexicon(units: DataFrame, model: str) -> DataFrame:
    """``unit, n, pieces``: every distinct pre-token encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count(b.column(0).to_pylist()), pa.int32())], names=["unit", "n", "pieces"])

    return units.select("unit", "n").mapInArrow(run, "unit string, n long, pieces int")


def frequent(lexicon: DataFrame, head: int) -> tuple[dict[str, int], int]:
    """At most ``head`` pre-tokens, down to the lowest power of two that their places reach; and that power."""
    short = lexicon.where(F.length("unit") <= 64)
    sizes = {r.b: r.k for r in short.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()}  # at most 64 rows
    cut, held = 64, 0
    while cut > 0 and held + sizes.get(cut - 1, 0) <= head:
        cut -= 1
        held += sizes.get(cut, 0)
    rows = short.where(F.floor(F.log2("n")) >= cut).select("unit", "pieces").toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())), cut


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", head: int = 400_000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens``: one row per document, in no order.

    Counts are those of encoding the whole text without begin or end tokens. Null text is
    empty and has no tokens. Repeated rows and null ids are kept, each row counted. Columns
    other than the two named are not read. Without rows the result is empty.
    """
    lexicon = settle(piece_lexicon(distinct_pretokens(docs, text_col), model), "pieces")
    known, cut = frequent(lexicon, head)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("head_tokens", T.LongType()), T.StructField("unit", T.StringType()), T.StructField("n", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        known = shared.value
        for b in batches:
            rows, units, ns, first, head_tokens, sizes = [], [], [], [], [], []
            for text in b.column(1).to_pylist():
                counts, tokens, rare = Counter(pretokens(text)), 0, []
                for u, n in counts.items():
                    p = known.get(u)
                    if p is None:
                        rare.append(u)
                    else:
                        tokens += n * p
                first.append(len(rows))
                head_tokens.append(tokens)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                if rare:
                    units += rare
                    ns += [counts[u] for u in rare]
                    rows += [row] * len(rare)
                else:  # a row of its own, under a key that no pre-token has
                    units.append(f" {row} \n")
                    ns.append(0)
                    rows.append(row)
                row += 1
            back: list[int | None] = [None] * len(rows)
            for i, at in enumerate(first):
                back[at] = i
            at = pa.array(back, pa.int32())
            cols = [pa.array(rows, pa.int64()), b.column(0).take(at), pa.array(sizes, pa.int64()).take(at), pa.array(head_tokens, pa.int64()).take(at), pa.array(units, pa.string()), pa.array(ns, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    found = docs.select(ref(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
    rare = lexicon.where((F.floor(F.log2("n")) < cut) | (F.length("unit") > 64)).select("unit", "pieces")
    tokens = F.coalesce(F.col("n") * F.col("pieces"), F.lit(0)) + F.coalesce("head_tokens", F.lit(0))
    out = found.join(rare, "unit", "left").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens")
