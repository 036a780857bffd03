"""Archives: an exact round trip, revisits, damage, and the merged order."""

import base64
import hashlib
import random
import tempfile

import pytest

from strikeline.llm import warc

SCHEMA = "page_id long, url string, html string"


def round_trip(spark, rows, held=warc.HELD, **how):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/warc"
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), folder, **how)
    return folder, warc.merge_runs(warc.read_archives(spark, folder), held)


def plain(rows, least=0):
    out = {}
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = max(same, default=None)
        visit = len(data) >= least and page is not None and page != first
        out[page] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if visit else "response", first if visit else None)
    return out


ROWS = [(1, "http://a.com/x", "hé"), (2, None, None), (3, "http://b.org:8080/", "hé"), (4, "http://a.com/x", ""), (5, "http://a.com/x\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"), (6, "u", "z" * 300_000), (None, "http://[bad", "z"), (7, "http://a.com/x", "hé")]


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(spark, least):
    _, got = round_trip(spark, ROWS, least_bytes=least)
    have = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()}
    assert have == plain(ROWS, least)


def test_merged_order_over_many_runs_and_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["http://hot.example.com/", f"https://h{i % 7}.example.org/{i % 11}?q={i % 3}"]), f"p{i % 40}") for i in range(500)]
    _, got = round_trip(spark, rows, held=60, records=23)
    have = got.orderBy("capture_seq").collect()
    assert [r.capture_seq for r in have] == list(range(500)) and len({r.run for r in have}) > 15
    order = [(r.url_key, r.captured, r.page_id) for r in have]
    assert order == sorted(order) and sorted(r.page_id for r in have) == list(range(500))


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        rows = [("r", n, None, rng.choice("abc"), rng.randint(0, 3), rng.choice([None, 1, 2]), 0, "", "", None) for n in range(80 if k else 0)]
        runs = [sorted(rows[i::k], key=warc.order) for i in range(k)] + ([[]] if k > 3 else [])
        assert list(warc.LoserTree(runs)) == sorted(rows, key=warc.order)


def test_damage_is_noticed_and_no_rows_are_fine(spark):
    folder, _ = round_trip(spark, [(1, "u", "payload")])
    text = spark.read.text(folder, wholetext=True).first()[0]
    bad = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/bad.warc"
    with open(bad, "w", newline="") as f:
        f.write(text.replace("payload\r\n", "pAyload\r\n"))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, bad).collect()
    assert round_trip(spark, [])[1].count() == 0


def test_extra_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS[:2], SCHEMA).withColumns({c: F.lit(1) for c in ("id", "payload", "n", "digest", "first", "at", "body")})
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/warc"
    warc.write_archives(df, folder)
    assert warc.read_archives(spark, folder).count() == 2
