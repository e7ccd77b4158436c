"""WARC archives: writing, and reading back by boundary-chain verification.

Writing uses Spark's own text sink, whose line separator is the blank line pair that ends a record, so archives can lie
in any store that Spark writes to. Of equal payloads of REVISIT_BYTES or more, the one with the largest page_id is the
response and the others are revisits of it: the maximum is combined before the shuffle and joined to rows without
payloads, so a hot payload moves a few dozen bytes for each copy.

Reading cuts the files at every magic, wherever it stands, in splits of any size. Each task emits its candidates: where a
record would start and where its successor would. A file's candidates (numbers only, no payloads) then meet; pointer
jumping from the start of the file keeps those that can be reached, so a magic inside a payload is never a record. A
payload that holds a magic was cut into chunks; only the chunks of such records are read again and joined in order.

Defined results: null html is an empty payload; a null url is an empty target; a null page_id is written as `null` and
comes back as null, always as a response; rows with the same page_id and payload are responses alike. Line breaks in
urls are percent-encoded. Extra columns are ignored. An empty table gives an empty table. A page of any length is one
record; of one that holds magics, the chunks meet in one task. A chain that breaks (a file that was cut off or damaged) ends
there: records after the break are not returned.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, released_shuffles

MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
REVISIT_BYTES, RECORDS_A_FILE = 1000, 10_000
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, refers_to (null for responses)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    narrow = own.filter(F.col("n_bytes") >= least).select("page_id", "digest", "n_bytes")
    first = narrow.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = narrow.join(first, ["digest", "n_bytes"]).filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    again = Scratch(pages.sparkSession, "warc-revisits").write(again, "revisits")  # its size is known then: where it is small, payloads need not move
    return own.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "n_bytes", "refers_to")


def write_warc(pages: DataFrame, path: str, least: int = REVISIT_BYTES, compression: str = "gzip") -> None:
    """A record for each page, in files of RECORDS_A_FILE records at most under `path`.

    A compressed file is read by one task; uncompressed ones (compression "none") are read in splits.
    """
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    rows = with_revisits(pages, least).withColumn("block", F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload"))))
    record = F.concat(F.lit(MAGIC.decode()), F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.col("block"))
    with released_shuffles(pages.sparkSession):
        rows.select(record.alias("value")).write.mode("overwrite").option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS_A_FILE).option("compression", compression).text(path)


_FIELD = re.compile(rb"^([A-Za-z-]+): ?(.*?)\r?$", re.M)
CANDIDATES = "file string, block long, seq long, n_chunk long, need long, record_id string, record_type string, uri string, refers_to string, stated_digest string, payload_bytes long, digest string"
_NAMES = [x.split()[0] for x in CANDIDATES.split(", ")]


def _payload(block: bytes) -> tuple[int | None, bytes]:
    """Stated length and the payload of an HTTP response block."""
    head, _, body = block.partition(END)
    stated = {k.lower(): v for k, v in _FIELD.findall(head)}.get(b"content-length", b"")
    return int(stated) if stated.isdigit() else None, body


def _candidate(chunk: bytes) -> tuple:
    """From the bytes between two magics: what a record that starts here would be. need: bytes to the successor's magic, or -1."""
    head, found, rest = chunk.partition(END)
    fields = {k.lower(): v for k, v in _FIELD.findall(head)} if found else {}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        return (-1, None, None, None, None, None, None, None)
    need, n, get = len(head) + 4 + int(length) + 4, int(length), lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    kind, size, digest = get(b"warc-type"), None, None
    if len(rest) >= n:
        stated, body = _payload(rest[:n])
        digest = hashlib.sha1(body).hexdigest() if kind == "response" else (get(b"warc-payload-digest") or "").removeprefix("sha1:")
        size = len(body) if kind == "response" else stated
    return (need, get(b"warc-record-id"), kind, get(b"warc-target-uri"), get(b"warc-refers-to"), (get(b"warc-payload-digest") or "").removeprefix("sha1:"), size, digest)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between the magics, in the order of each split."""
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("chunk"))


def _numbered(batches):
    """(file, block, seq, chunk) of a task's rows; seq counts within a split."""
    at, seq = None, 0
    for batch in batches:
        for file, block, chunk in zip(*(batch.column(i).to_pylist() for i in range(3))):
            at, seq = ((file, block), 0) if (file, block) != at else (at, seq + 1)
            yield file, block, seq, chunk


def _emit(batches):
    rows = []
    for file, block, seq, chunk in _numbered(batches):
        rows.append((file, block, seq, len(chunk), *_candidate(chunk)))
        if len(rows) == 5000:
            yield _table(rows)
            rows = []
    if rows:
        yield _table(rows)


_SCHEMA = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in CANDIDATES.split(", ")])
RECORDS = CANDIDATES + ", offset long, chunks long"


def _table(rows: list[tuple], schema: pa.Schema = _SCHEMA) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def reachable(starts: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which of the records at `starts` (ascending) the chain from the first meets, by pointer jumping."""
    n = len(starts)
    at = np.searchsorted(starts, successors)
    jump = np.append(np.where((at < n) & (starts[np.minimum(at, n - 1)] == successors), at, n), n)
    met = np.zeros(n + 1, bool)
    met[0] = n > 0
    for _ in range(max(1, n).bit_length()):  # all within 2**k steps are met after k rounds
        met[jump[np.flatnonzero(met)]] = True
        jump = jump[jump]
    return met[:n]


def _verify(rows: pa.Table) -> pa.Table:
    """The records of one file; rows: its candidates, payloads left out."""
    rows = rows.sort_by([("block", "ascending"), ("seq", "ascending")])
    size = rows.column("n_chunk").to_numpy()
    start = np.concatenate(([0], np.cumsum(size + len(MAGIC))))[:-1] if len(size) else size  # of each chunk
    need = rows.column("need").to_numpy()
    able = np.flatnonzero((need >= 0) & (start > 0))
    offset = start - len(MAGIC)
    if not len(able) or offset[able[0]] != 0:
        return rows.slice(0, 0).append_column("offset", pa.array([], pa.int64())).append_column("chunks", pa.array([], pa.int64()))
    met = able[reachable(offset[able], start[able] + need[able])]
    last = np.searchsorted(offset, start[met] + need[met])
    out = rows.take(pa.array(met))
    return out.append_column("offset", pa.array(offset[met])).append_column("chunks", pa.array((last - met).astype(np.int64)))


def _joined(rows: pa.Table) -> pa.Table:
    """One record whose payload holds magics: its chunks in order, and the digest."""
    rows = rows.sort_by("n")
    block = MAGIC.join(rows.column("chunk").to_pylist())
    head, _, rest = block.partition(END)
    need = rows.column("need")[0].as_py()
    _, body = _payload(rest[: need - len(head) - 8])
    return pa.table({"file": [rows.column("file")[0].as_py()], "offset": [rows.column("offset")[0].as_py()], "size2": pa.array([len(body)], pa.int64()), "digest2": [hashlib.sha1(body).hexdigest()]})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under `path`: file, offset, record_id, record_type, uri, refers_to, payload_bytes, payload_digest, and the digest stated in the header."""
    scratch = Scratch(spark, "warc-index")
    found = scratch.write(_chunks(spark, path).mapInArrow(_emit, CANDIDATES), "candidates")
    records = scratch.write(found.groupBy("file").applyInArrow(_verify, RECORDS), "records")
    cut = records.filter(F.col("digest").isNull() & F.col("payload_bytes").isNull() & (F.col("chunks") > 1))
    if cut.isEmpty():
        again = None
    else:
        # Chunks of cut records, by file, split and number: a record can go on in later splits.
        order = found.join(cut.select("file").distinct(), "file", "left_semi").select("file", "block", "seq", "n_chunk")
        wanted = scratch.write(order.groupBy("file").cogroup(cut.select("file", "offset", "need", "block", "seq", "chunks").groupBy("file")).applyInArrow(_wanted, "file string, block long, seq long, offset long, need long, n long"), "wanted")

        def bodies(batches):
            for file, block, seq, chunk in _numbered(batches):
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([seq], pa.int64()), pa.array([chunk], pa.binary())], names=["file", "block", "seq", "chunk"])

        again = (
            _chunks(spark, path).mapInArrow(bodies, "file string, block long, seq long, chunk binary").join(wanted, ["file", "block", "seq"])
            .groupBy("file", "offset").applyInArrow(_joined, "file string, offset long, size2 long, digest2 string")
        )
    if again is not None:
        records = records.join(again, ["file", "offset"], "left").withColumns({"payload_bytes": F.coalesce("payload_bytes", "size2"), "digest": F.coalesce("digest", "digest2")})
    return records.select("file", "offset", "record_id", "record_type", "uri", "refers_to", "payload_bytes", F.col("digest").alias("payload_digest"), "stated_digest")


def _wanted(chunks: pa.Table, cut: pa.Table) -> pa.Table:
    chunks = chunks.sort_by([("block", "ascending"), ("seq", "ascending")])
    blocks, seqs = chunks.column("block").to_numpy(), chunks.column("seq").to_numpy()
    place = {x: i for i, x in enumerate(zip(blocks.tolist(), seqs.tolist()))}
    rows = []
    for r in cut.to_pylist():
        first = place[r["block"], r["seq"]]
        rows += [(r["file"], int(blocks[i]), int(seqs[i]), r["offset"], r["need"], n) for n, i in enumerate(range(first, first + r["chunks"]))]
    schema = pa.schema([("file", pa.string()), *((k, pa.int64()) for k in ("block", "seq", "offset", "need", "n"))])
    return pa.Table.from_batches([_table(rows, schema)] if rows else [], schema)


def archive_round_trip(pages: DataFrame, compression: str = "none") -> DataFrame:
    """Write the pages as WARC records in the shared folder, read the archives back, and return a row for each page.

    Uncompressed archives are read in splits, so a split's first magic may stand inside a payload: that is what the chains are for.
    """
    spark = pages.sparkSession
    path = Scratch(spark, "warc").path("archives")
    write_warc(pages, path, compression=compression)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_warc(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "uri", "stated_digest")
