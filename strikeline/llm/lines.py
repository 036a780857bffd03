"""Line dedup by a segment-partition edit join.

Two lines match at k or fewer edits, where k grows with the length of the shorter one. A line
is cut into k + 1 nearly equal segments: k edits leave one of them untouched, so a matching
line has it as a substring, at a place that its number and the two lengths narrow down to a
few. Lines stand in the buckets of their own segments (length, number, content) and probe
those of every length they could match. Lines that meet are compared first by a 64-bit sketch
of their character trigrams, of which an edit changes at most six bits, and then, with
their texts, by a banded bit-parallel edit distance.

Lines are one node each however often they stand in the corpus; texts move only for lines
that have a likely partner. Buckets with very many lines are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.common import fresh, map_rows, ref
from strikeline.llm.decontaminate import codes
from strikeline.llm.links import AT_ONCE, cells, components, per_cell
from strikeline.plans.tables import settle

BASE = 0x9E3779B97F4A7C15
MOST_EDITS, PER_EDIT = 2, 20
STRETCH = 1 << 20  # characters hashed at a time
CELL = 2048
SAMPLE = 8  # one line in so many is counted to decide how buckets are dealt to tasks, not what they hold
HELD = 200_000  # lines that a task remembers having seen
LISTED = 2_000_000  # handles, 16 MB, up to which lines with partners are picked where texts are read


def digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def handle(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def lines_of(text: str | None) -> Iterator[tuple[int, bytes]]:
    """Number and content of every line with a word, without the white space around it."""
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        line = line.strip()
        if line:
            yield i, line


def fresh_lines(texts: list[str | None], seen: set[bytes]) -> list[tuple[bytes, str]]:
    """Lines long enough for an edit that this task has not met lately."""
    out = []
    for text in texts:
        for _, line in lines_of(text):
            if len(line) >= PER_EDIT:
                d = digest(line)
                if d not in seen:
                    if len(seen) >= HELD:
                        seen.clear()
                    seen.add(d)
                    out.append((d, line.decode("utf-8", "surrogatepass")))
    return out


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(BASE, -1, 2**64), np.uint64)])
    return up, down


def edits_of(length: np.ndarray) -> np.ndarray:
    return np.minimum(MOST_EDITS, length // PER_EDIT)


def bucket_rows(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket keys with the number of the line that stands in or probes them; and the lines' sketches."""
    size = np.array([len(x) for x in lines], np.int64)
    start = np.cumsum(size) - size
    x = codes("".join(lines))
    up, down = powers(max(STRETCH, 1 << int(len(x)).bit_length()))
    with np.errstate(over="ignore"):
        prefix = np.r_[np.uint64(0), np.cumsum((x + np.uint64(1)) * up[: len(x)])]
        grams = (x[:-2] * np.uint64(0xBF58476D1CE4E5B9) + x[1:-1]) * np.uint64(0x94D049BB133111EB) + x[2:]
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(BASE)
        marks = np.r_[np.uint64(1) << (grams >> np.uint64(58)), np.zeros(2, np.uint64)]
        edge = start + size  # trigrams that reach into the next line do not count
        marks[edge - 1] = marks[edge - 2] = 0
        sketch = np.bitwise_xor.reduceat(marks, start)

        def key(who: np.ndarray, at: np.ndarray, n: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
            begin = start[who] + at
            h = (prefix[begin + n] - prefix[begin]) * down[begin]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + (length * 8 + i).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            return h ^ (h >> np.uint64(29))

        keys, owners = [], []
        for gap in range(MOST_EDITS + 1):
            length = size - gap
            k = np.where(length > 0, edits_of(length), 0)
            for i in range(MOST_EDITS + 1):
                who = np.flatnonzero((k >= np.maximum(i, max(gap, 1))))
                if not len(who):
                    continue
                n_of, l_of = k[who] + 1, length[who]
                short, longer = l_of // n_of, l_of % n_of
                n = short + (i >= n_of - longer)
                place = short * i + np.maximum(0, i - (n_of - longer))
                low = np.maximum(0, np.maximum(place - i, place + gap - (k[who] - i)))
                high = np.minimum(size[who] - n, np.minimum(place + i, place + gap + (k[who] - i)))
                for shift in range(-MOST_EDITS, 2 * MOST_EDITS + 1):
                    at = place + shift
                    ok = (at >= low) & (at <= high)
                    if ok.any():
                        keys.append(key(who[ok], at[ok], n[ok], l_of[ok], i))
                        owners.append(who[ok])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *keys]).view(np.int64), np.concatenate([np.zeros(0, np.int64), *owners]), sketch.view(np.int64)


def rows_of(docs: DataFrame, sample: int = 1) -> DataFrame:
    """``key, handle, sketch`` of the lines of ``docs(text)``; of one line in ``sample``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            group, chars = [], 0
            for d, line in fresh_lines(b.column(0).to_pylist(), seen):
                h = handle(d)
                if h % sample == 0:
                    group.append((h, line))
                    chars += len(line)
                if chars >= STRETCH:
                    yield out(group)
                    group, chars = [], 0
            if group:
                yield out(group)

    def out(group: list[tuple[int, str]]) -> pa.RecordBatch:
        keys, owners, sketch = bucket_rows([x for _, x in group])
        handles = np.array([h for h, _ in group], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(handles[owners]), pa.array(sketch[owners])], names=["key", "handle", "sketch"])

    return docs.mapInArrow(run, "key long, handle long, sketch long")


def likely(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """The rows of each cell that have a partner with a like sketch."""
    h, s = b.column("handle").to_numpy(), b.column("sketch").to_numpy().view(np.uint64)
    n, far = len(h), 6 * MOST_EDITS
    ends = np.r_[starts[1:], n]
    sizes = ends - starts
    active = np.zeros(n, bool)
    last = np.repeat(np.where(sizes <= AT_ONCE, ends, starts), sizes)
    rows = np.arange(n)
    for lag in range(1, AT_ONCE):
        rows = rows[rows + lag < last[rows]]
        if not len(rows):
            break
        ok = rows[(np.bitwise_count(s[rows] ^ s[rows + lag]) <= far) & (h[rows] != h[rows + lag])]
        active[ok] = active[ok + lag] = True
    for a, e in zip(starts[sizes > AT_ONCE].tolist(), ends[sizes > AT_ONCE].tolist()):
        for r in range(a, e, 256):
            near = (np.bitwise_count(s[r : min(r + 256, e), None] ^ s[None, a:e]) <= far) & (h[r : min(r + 256, e), None] != h[None, a:e])
            active[r : min(r + 256, e)] |= near.any(axis=1)
    at = pa.array(np.flatnonzero(active))
    return b.select(["key", "cell", "handle", "sketch"]).take(at)


def within(a: str, b: str, k: int) -> bool:
    """Whether two strings are at most ``k`` edits apart: a bit vector of the 2k + 1 diagonals, moved down the matrix."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return False
    low, high = 0, len(a)
    while low < high:  # length of the common start
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    a, b = a[low:], b[low:]
    low, high = 0, len(a)
    while low < high:  # length of the common end
        mid = (low + high + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            low = mid
        else:
            high = mid - 1
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a or not b:
        return len(b) <= k
    if len(b) <= k:
        return True
    # rows are letters of b; bit t of column j is row j - k + t
    letters: dict[str, int] = {}
    for i, c in enumerate(b):
        letters[c] = letters.get(c, 0) | 1 << (i + k)
    width = 2 * k + 1
    full, m = (1 << width) - 1, len(b)
    up, down, score = full ^ ((1 << k) - 1), 0, k  # rows above the first do not count
    for j, c in enumerate(a):
        match = (letters.get(c, 0) >> j) & full
        d0 = ((((match & up) + up) ^ up) | match | down) & full
        hp, hn = (down | ~(d0 | up)) & full, d0 & up
        if j + k < m:  # the lowest diagonal is still inside: its value steps along it
            score += not (d0 >> (2 * k)) & 1
        else:
            t = m - 1 - j + k  # row m in this column
            score += ((hp >> t) & 1) - ((hn >> t) & 1)
        step = d0 >> 1
        up, down = (hn | ~(step | hp)) & full, hp & step
    return score <= k


def verify(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """Links within cells, enough to connect whatever is connected there."""
    ids, lines, sketch = b.column("digest").to_pylist(), b.column("line").to_pylist(), b.column("sketch").to_numpy().view(np.uint64)
    ends, left, right = [*starts[1:].tolist(), len(ids)], [], []

    def near(i: int, j: int) -> bool:
        x, y = lines[i], lines[j]
        return ids[i] != ids[j] and within(x, y, int(min(MOST_EDITS, min(len(x), len(y)) // PER_EDIT)))

    for s, e in zip(starts.tolist(), ends):
        waiting = np.arange(s, e)
        letters = np.stack([np.bincount((codes(x) % np.uint64(61)).astype(np.int64), minlength=61) for x in lines[s:e]])  # an edit changes two counts at most
        while len(waiting) > 1:
            queue, waiting = [int(waiting[0])], waiting[1:]
            while queue and len(waiting):
                pivot = queue.pop()
                like = np.flatnonzero(np.bitwise_count(sketch[waiting] ^ sketch[pivot]) <= 6 * MOST_EDITS)
                like = like[np.abs(letters[waiting[like] - s] - letters[pivot - s]).sum(axis=1) <= 2 * MOST_EDITS]
                like = [k for k in like.tolist() if near(pivot, int(waiting[k]))]
                found = waiting[like].tolist()
                left += [ids[pivot]] * len(found)
                right += [ids[j] for j in found]
                queue += found
                waiting = np.delete(waiting, like)
    return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])


def line_links(texts: DataFrame, cell: int = CELL) -> DataFrame:
    """``a, b`` (digests): links between different lines of ``texts(text)`` that connect all that match."""
    counted = rows_of(texts, SAMPLE).groupBy("key").agg((F.count(F.lit(1)) * SAMPLE).alias("_n"))
    rows = cells(rows_of(texts), "key", "handle", cell, counted)
    met = settle(per_cell(rows.select("key", "handle", "sketch", "cell"), "key", likely, "key long, cell long, handle long, sketch long").distinct(), "met")
    handles = settle(met.select("handle").distinct(), "handles")
    known = texts_of(texts, handles).dropDuplicates(["digest"])
    pairs = met.join(known, "handle").select("key", "cell", "sketch", "digest", "line")
    return per_cell(pairs, "key", verify, "a binary, b binary").distinct()


def texts_of(texts: DataFrame, handles: DataFrame) -> DataFrame:
    """``handle, digest, line`` of the lines with these handles: picked where they are read while the handles
    fit in a bounded list, else by a join."""
    n = handles.count()
    wanted = np.sort(handles.toArrow().column(0).to_numpy()) if n <= LISTED else None
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        wanted = shared.value
        for b in batches:
            got = fresh_lines(b.column(0).to_pylist(), seen)
            keys = np.array([handle(d) for d, _ in got], np.int64)
            if wanted is not None:
                at = np.flatnonzero(np.isin(keys, wanted)) if len(wanted) else []
                got, keys = [got[i] for i in at], keys[at] if len(at) else keys[:0]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([d for d, _ in got], pa.binary()), pa.array([x for _, x in got], pa.string())], names=["handle", "digest", "line"])

    found = texts.mapInArrow(run, "handle long, digest binary, line string")
    return found if wanted is not None else found.join(handles, "handle")


def places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_id, line_no, digest``: every line with a word."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_id", T.BinaryType()), T.StructField("line_no", T.IntegerType()), T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts, numbers, digests = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text:
                    own = text_id(text)
                    for k, line in lines_of(text):
                        at.append(i)
                        texts.append(own)
                        numbers.append(k)
                        digests.append(digest(line))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(texts, pa.binary()), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary())], names=schema.names)

    return docs.select(ref(id_col).alias("doc_id"), ref(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def text_id(text: str | None) -> bytes:
    return digest((text or "").encode("utf-8", "surrogatepass"))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_id, line_no, class_doc_id, class_line_no, kept``: one row per line with a word.

    Lines are stripped of the white space around them. Equal lines, and lines connected by matches, are one
    class; its place is its first line, by document id (null last), text and line number, and only that is kept.
    Lines under 20 characters match only equal ones; one edit from 20 characters on, two from 40 (of the shorter).

    Null or empty texts have no lines. Rows equal in id and text are one document: their lines share their
    places and decisions, and come once per row. Other columns are not read. Without rows: empty.
    """
    rows = settle(places(docs, id_col, text_col), "places")
    texts = docs.select(ref(text_col).cast("string").alias("text"))
    found = settle(components(line_links(texts), "a", "b"), "line-classes")
    # digests that stand once and have no match need no class
    often = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("digest")
    named = found.select(F.col("node").alias("digest"), "root")
    known = settle(often.join(named, "digest", "full").select("digest", F.coalesce("root", "digest").alias("root")), "repeated")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id", "line_no")
    held = settle(rows.join(known, "digest").select(place.alias("place"), "root"), "held")
    first = held.groupBy("root").agg(F.min("place").alias("first"))
    moved = held.join(first, "root").where(F.col("place") != F.col("first")).select("place.*", "first")
    keys = ["doc_id", "text_id", "line_no"]
    moved = moved.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_id") == F.col("_text_id")) & (F.col("line_no") == F.col("_line_no"))
    out = rows.join(moved, same, "left")
    kept = F.col("_line_no").isNull()
    return out.select(*keys, F.when(kept, F.col("doc_id")).otherwise(F.col("class_doc_id")).alias("class_doc_id"), F.coalesce("class_line_no", "line_no").alias("class_line_no"), kept.alias("kept"))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the lines that are not the first of their class; documents left without a word go, as do
    those that had none. Columns stay as they are; ``chars_col`` follows the text where it exists."""
    own, other, key, gone = fresh(docs, "text_id", "other_text_id", "other_id", "gone")
    gone_lines = line_classes(docs, id_col, text_col).where(~F.col("kept")).groupBy("doc_id", "text_id").agg(F.collect_set("line_no").alias(gone))
    gone_lines = gone_lines.withColumnRenamed("doc_id", key).withColumnRenamed("text_id", other)
    named = map_rows(docs, lambda texts: {own: pa.array([text_id(t) for t in texts], pa.binary())}, [T.StructField(own, T.BinaryType())], text_col)
    out = named.join(gone_lines, ref(id_col).eqNullSafe(ref(key)) & (ref(own) == ref(other)), "left")
    stay = F.array_join(F.filter(F.split(ref(text_col), "\n"), lambda _, i: ~F.array_contains(ref(gone), i)), "\n")
    text = F.when(ref(gone).isNull(), ref(text_col)).otherwise(stay)
    out = out.withColumn(text_col, text).where(ref(text_col).rlike(r"[^\x20\x09-\x0D]"))
    swap = {chars_col: F.length(ref(text_col)).cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {}
    return out.select(*[(swap[c] if c in swap else ref(c)).alias(c) for c in docs.columns])
