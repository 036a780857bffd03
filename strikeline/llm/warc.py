"""Web archives: write records, read them back, merge capture indexes.

``write_archives`` writes WARC 1.1 files with Spark's text writer: one response record per
distinct payload, and revisit records for its other captures. ``read_archives`` parses the
files by their lengths, verifies digests, and yields each file's captures as a run sorted by
URL key and time. ``merge_runs`` merges the runs into one globally ordered index: the order
is cut into key ranges, and each range is merged from its runs with a loser tree.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.llm.common import ref
from strikeline.plans.tables import settle

END = "\r\n"
CAPTURE = "run string, offset long, url string, url_key string, captured timestamp, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
HELD = 100_000  # captures of a key range that one task merges, about
RECORDS = 4096  # records of a file at most


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: 8 groups of 5 hex digits, 4 letters each."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured: Column | None = None, least_bytes: int = 0, records: int = RECORDS) -> None:
    """Write one record per row of ``pages`` below ``folder``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the largest id becomes a response
    and the others revisits that refer to it; smaller payloads are all responses. A null payload is
    empty, a null URL is left out of its record, a null id makes a response. Rows that repeat the largest id of
    their payload are all responses. ``captured`` is the time of capture; without it, a fixed start
    plus the id in seconds. Extra columns are not read. Without rows, no record is written.

    Payloads are not shuffled unless the payloads with copies are too many to broadcast.
    """
    spark = pages.sparkSession
    captured = captured if captured is not None else F.timestamp_seconds(F.lit(1704067200) + F.coalesce(ref(id_col).cast("long"), F.lit(0)))
    text = F.coalesce(ref(payload_col), F.lit(""))
    x = pages.select(ref(id_col).cast("long").alias("id"), ref(url_col).alias("url"), text.alias("payload"), captured.alias("at"))
    x = x.withColumn("n", F.octet_length("payload")).withColumn("digest", base32_sha1(F.encode("payload", "UTF-8")))
    same = x.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    same = settle(same, "copies")  # its size on disk lets the planner choose the join
    x = x.join(same, ["digest", "n"], "left")
    visit = F.col("first").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("first"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(END))

    def urn(i: Column) -> Column:
        h = F.md5(F.concat(F.lit("record"), i.cast("string")).cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), line("Content-Length", F.col("n").cast("string")), F.lit(END))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.when(visit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.coalesce(F.col("id").cast("string"), F.col("digest")))), line("WARC-Date", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.coalesce(line("X-Page-ID", F.col("id").cast("string")), F.lit("")),
        F.when(visit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}"), line("WARC-Refers-To", urn(F.col("first").cast("string"))), line("X-Refers-To-Page-ID", F.col("first").cast("string")))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
    )
    body = F.concat(http, F.when(visit, F.lit("")).otherwise(F.col("payload")))
    record = F.concat(head, line("Content-Length", F.octet_length("body").cast("string")), F.lit(END), F.col("body"), F.lit(END + END))
    x.withColumn("body", body).select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", records).text(folder)


def parse(data: bytes) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """Offset, named fields and block of each record; blank lines between records are skipped."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        version, *fields = bytes(view[at:end]).split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        named = {k.strip().lower(): v.strip() for k, _, v in (f.partition(b":") for f in fields)}
        size = int(named[b"content-length"])
        yield at, named, bytes(view[end + 4 : end + 4 + size])
        at = end + 4 + size


def url_key(url: str | None) -> str:
    """The sort key of a URL: host parts reversed, then path and query, without scheme, user, port 80/443 or fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url.lower())
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
        host = ",".join(reversed((u.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}{port}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all files below ``folder``, each file a run sorted by URL key, time and id.

    Digest and length are those of the full payload: computed for a response, and checked against its
    header; taken from the headers for a revisit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import datetime as dt

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for at, f, block in parse(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    lengths = [int(x.split(b":")[1]) for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:")]
                    digest, kind = f[b"warc-payload-digest"].removeprefix(b"sha1:").decode(), f[b"warc-type"].decode()
                    if kind == "response" and (b32encode(hashlib.sha1(payload).digest()).decode() != digest or lengths != [len(payload)]):
                        raise ValueError(f"{path}: the record at {at} is damaged")
                    url = f[b"warc-target-uri"].decode() if b"warc-target-uri" in f else None
                    when = dt.datetime.strptime(f[b"warc-date"].decode(), "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=dt.timezone.utc)
                    page, other = (int(f[k]) if k in f else None for k in (b"x-page-id", b"x-refers-to-page-id"))
                    rows.append((path, at, url, url_key(url), when, page, lengths[0], digest, kind, other))
                rows.sort(key=order)
                yield batch(rows)

    # Without records Spark still writes one empty file.
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")
    return files.mapInArrow(run, CAPTURE)


def batch(rows: list[tuple], *more: pa.Array) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in CAPTURE.split(", ")] + ["nth"] * len(more)
    cols = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)] + list(more), names=names)


def order(row: tuple) -> tuple:
    """URL key, time, id (null first), run, offset: total, so that a merge has one result."""
    return row[3], row[4], row[5] is not None, row[5] or 0, row[0], row[1]


class LoserTree:
    """Merges sorted runs: inner nodes keep the losers of their matches, so each row costs one path to the root."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.heads = [order(r[0]) if r else None for r in runs]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._play(1) if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def _play(self, node: int) -> int:
        """Fill the tree below ``node``: leaves are nodes k to 2k-1."""
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._beats(a, b):
            self.losers[node] = b
            return a
        self.losers[node] = a
        return b

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = order(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            node = (w + self.k) // 2
            while node:
                if not self._beats(w, self.losers[node]):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def merge_runs(runs: DataFrame, held: int = HELD) -> DataFrame:
    """All captures with ``capture_seq``, their place in the global order from 0.

    The order is by URL key, time and id, so a URL with very many captures is cut by time and no range grows.
    A task holds one range, about ``held`` captures, as the runs that reach into it. Without captures: empty.
    """
    runs = settle(runs, "runs")
    ranges = max(1, -(-runs.count() // held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                parts.setdefault(row[0], []).append(row)
        out, nth = [], 0
        for row in LoserTree(list(parts.values())):
            out.append(row)
            if len(out) == 8192:
                yield batch(out, pa.array(range(nth, nth + len(out)), pa.int64()))
                nth, out = nth + len(out), []
        if out:
            yield batch(out, pa.array(range(nth, nth + len(out)), pa.int64()))

    keys = ["url_key", "captured", "page_id", "run", "offset"]
    dealt = runs.repartitionByRange(ranges, *keys).sortWithinPartitions("run", *keys[:3], "offset")
    merged = settle(dealt.mapInArrow(run, f"{CAPTURE}, nth long").withColumn("range", F.spark_partition_id()), "merged")
    before = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("base"))  # one row per range
    return merged.join(F.broadcast(before) if ranges <= 10_000 else before, "range").withColumn("capture_seq", F.col("base") + F.col("nth")).drop("range", "base", "nth")
