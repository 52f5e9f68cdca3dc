import base64
import hashlib

from pyspark.sql import functions as F

from shapecast.llm.warc_shards import read_archives, write_archives

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    largest = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= least:
            largest[b] = max(largest.get(b, -10**9), -10**9 if i is None else i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        revisit = len(b) >= least and i != largest[b]
        out.append((i, len(b), d, "revisit" if revisit else "response", largest[b] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(i, f"http://x/{i} \n", "é" * (i % 7) + ("same" if i % 3 else str(i))) for i in range(300)]
    rows += [(900, None, None), (901, "u", ""), (-5, "u", "z" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("sha1", F.lit("clash")).repartition(5)
    for least in (0, 6):
        folder, manifest = write_archives(df, min_revisit_bytes=least, roll_bytes=2000, shard_rows=50)
        got = sorted((tuple(r) for r in read_archives(folder, manifest).collect()), key=str)
        assert got == brute(rows, least)
        assert manifest.count() > 5


def test_same_bytes_twice(spark):
    rows = [(i, "u", str(i % 40)) for i in range(200)]
    seen = set()
    for parts in (1, 6):
        _, m = write_archives(spark.createDataFrame(rows, SCHEMA).repartition(parts), shard_rows=60)
        seen.add(tuple(sorted((r.file, r.sha256) for r in m.collect())))
    assert len(seen) == 1


def test_odd_rows(spark):
    rows = [(None, "u", "a"), (7, "u", "a"), (7, "u", "a"), (7, "u", "b"), (None, None, "only")]
    got = read_archives(*write_archives(spark.createDataFrame(rows, SCHEMA))).collect()
    kinds = sorted((str(r.page_id), r.payload_digest[:3], r.record_type, r.refers_to) for r in got)
    assert len(got) == 5 and sum(r.record_type == "revisit" for r in got) == 2
    assert all(r.refers_to == 7 for r in got if r.record_type == "revisit"), kinds
    assert read_archives(*write_archives(spark.createDataFrame([], SCHEMA))).count() == 0
