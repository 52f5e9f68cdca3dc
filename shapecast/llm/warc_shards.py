"""Deterministic sharded WARC writer and the reader that checks it.

Records are cut into id ranges (shards), sorted inside each, and written as
one gzip member per record; a file is rolled when its compressed size reaches
``roll_bytes``. Headers and digests are regenerated from the payload. A file
is written under a temporary name and renamed when it is complete; a manifest
row per file (name, sizes, SHA-256) is what commits it, and the reader opens
only files of the manifest. Every name and byte follows from the rows alone
(no clock, no attempt number in the final name), so a task that runs again
after a lost executor replaces its files by equal ones.

Defined cases: a null payload is an empty one; a null id sorts first and is
read back as null; repeated rows (same id and payload) are one response and
revisits of that id; a null url is written as ``about:blank``; an empty table
gives no file and no row. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, shared_path, written

MANIFEST = ("shard long, seq long, file string, n_records long, file_bytes long, "
            "raw_bytes long, sha256 string")
READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long")
#: Ids looked at to place the shard bounds; the hash that picks them is fixed.
BOUND_SAMPLE = 20_000
#: At most so many shards (a shard holds as many files as it needs).
MAX_SHARDS = 4096
DATE = "1970-01-01T00:00:00Z"


def _bounds(ids: DataFrame, shards: int) -> list[int]:
    """Shard bounds: quantiles of the ids whose hash falls into a fixed slice.
    They only deal out the work; no row depends on them."""
    n = ids.count()
    slices = max(1, n // BOUND_SAMPLE)
    some = sorted(r[0] for r in ids.where(F.col("id").isNotNull())
                  .where(F.pmod(F.xxhash64("id"), F.lit(slices)) == 0).collect())
    if not some:
        return []
    return sorted({some[len(some) * k // shards] for k in range(1, shards)})


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:x-page:{'null' if page is None else page}:{digest}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    head += f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _record(page, url, payload: bytes, digest: str, refers) -> bytes:
    """``refers``: False for a response, else the id (or None) of the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers is False else b"")
    kind = "response" if refers is False else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page, digest) if refers is False
                else f"<urn:x-revisit:{'null' if page is None else page}:{digest}>"),
               ("WARC-Date", DATE),
               ("WARC-Target-URI", quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")),
               ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    if refers is not False:
        headers += [("WARC-Refers-To", _record_id(refers, digest)),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _member(headers, block)


def _write_partition(folder: str, roll_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(folder)
        state = {"shard": None, "seq": 0, "buf": io.BytesIO(), "n": 0, "raw": 0}

        def flush():
            if not state["n"]:
                return None
            data = state["buf"].getvalue()
            name = f"part-{state['shard']:05d}-{state['seq']:06d}.warc.gz"
            temp = f"{base}/.tmp-{name}-{os.getpid()}-{uuid.uuid4().hex}"
            with fs.open_output_stream(temp, compression=None) as out:
                out.write(data)
            fs.move(temp, f"{base}/{name}")
            row = (state["shard"], state["seq"], name, state["n"], len(data), state["raw"],
                   hashlib.sha256(data).hexdigest())
            state.update(seq=state["seq"] + 1, buf=io.BytesIO(), n=0, raw=0)
            return row

        refers = {}          # the markers of the id now passing: digest -> id of the response
        at, done = None, set()
        for batch in batches:
            rows = []
            for shard, page, kind, url, payload, sha1, target in zip(
                    *(batch[c].tolist() for c in ("shard", "id", "kind", "url", "payload", "sha1", "target"))):
                page = None if pd.isna(page) else int(page)
                if shard != state["shard"]:
                    rows.append(flush())
                    state.update(shard=shard, seq=0)
                    at = None
                if at != (page,):
                    at, refers, done = (page,), {}, set()
                if kind == 0:
                    refers[sha1] = None if pd.isna(target) else int(target)
                    continue
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                body = payload.encode()
                first = sha1 not in refers or (refers[sha1] == page and sha1 not in done)
                done.add(sha1)
                if state["n"] == 0:
                    state["buf"].write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID",
                                       f"<urn:x-file:{shard}:{state['seq']}>"), ("WARC-Date", DATE),
                                       ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                state["buf"].write(_record(page, url, body, digest, False if first else refers[sha1]))
                state["n"] += 1
                state["raw"] += len(body)
                if state["buf"].tell() >= roll_bytes:
                    rows.append(flush())
            rows = [r for r in rows if r]
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in MANIFEST.split(", ")])
        last = flush()
        if last:
            yield pd.DataFrame([last], columns=[c.split()[0] for c in MANIFEST.split(", ")])
    return run


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_revisit_bytes: int = 0,
                   roll_bytes: int = 16 << 20, shard_rows: int = 4000) -> tuple[str, DataFrame]:
    """Writes every row; returns the folder and the manifest table.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the one
    with the largest id becomes the response, the others revisits of it.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("payload", "UTF-8")))
    # Copies: counts and largest ids are combined before the shuffle; only ids and
    # digests move, and the join back is one that splits a hot digest at run time.
    keys = rows.where(F.octet_length("payload") >= min_revisit_bytes).select("id", "sha1")
    again = keys.groupBy("sha1").agg(F.max("id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = written(keys.join(again.select("sha1", "target"), "sha1").select("id", "sha1", "target"), "warc-marks")
    n = rows.select("id").count()
    shards = max(1, min(MAX_SHARDS, -(-n // shard_rows)))
    cut = np.array(_bounds(rows.select("id"), shards), dtype=np.int64)

    @F.pandas_udf("long")
    def shard_of(ids: pd.Series) -> pd.Series:
        got = np.searchsorted(cut, ids.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(ids.isna(), 0, got))

    both = (rows.select("id", F.lit(1).alias("kind"), "url", "payload", "sha1", F.lit(None).cast("long").alias("target"))
            .unionByName(marks.distinct().select("id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                                                 F.lit(None).cast("string").alias("payload"), "sha1", "target"))
            .withColumn("shard", shard_of("id")))
    folder = shared_path(spark, "warc")
    # the folder itself, so that a task finds it whatever store it is in
    spark.range(1).select(F.lit("WARC 1.1").alias("format")).coalesce(1).write.json(folder)
    dealt = (both.repartition(shards, "shard")
             .sortWithinPartitions("shard", "id", "kind", "sha1", "url"))
    manifest = written(dealt.mapInPandas(_write_partition(folder, roll_bytes), MANIFEST), "warc-manifest")
    return folder, manifest


def _read_file(data: bytes) -> Iterator[tuple[dict, bytes]]:
    while data:
        unzip = zlib.decompressobj(31)
        raw = unzip.decompress(data) + unzip.flush()
        data = unzip.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[:int(headers["Content-Length"])]
        if rest[len(block):] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield headers, block


def _page(record_id: str) -> int | None:
    part = record_id.split(":")[2]
    return None if part == "null" else int(part)


def read_archives(folder: str, manifest: DataFrame) -> DataFrame:
    """One row per record of the files that the manifest names; sizes, file
    hashes and payload digests are checked, a mismatch raises."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(folder)
        for batch in batches:
            for name, sha256 in zip(batch["file"], batch["sha256"]):
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != sha256:
                    raise ValueError(f"{name} differs from the manifest")
                out = []
                for headers, block in _read_file(data):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    if kind == "response" and (len(payload) != size or base64.b32encode(
                            hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"a payload of {name} differs from its digest")
                    out.append((_page(headers["WARC-Record-ID"]), size, digest, kind,
                                _page(headers["WARC-Refers-To"]) if kind == "revisit" else None))
                got = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield got.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = manifest.count()
    dealt = manifest.select("file", "sha256").repartition(max(1, min(files, 100_000)))
    return dealt.mapInPandas(run, READ)
