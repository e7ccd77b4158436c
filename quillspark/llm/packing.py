"""Packing along a space-filling curve.

A document's hashed token counts, projected to a few dimensions, give its Hilbert key. Documents are range-sorted by
that key and laid end to end along the curve into sequences of `length` ids; a document is cut wherever a sequence ends.
Each range partition fills sequences of its own, so only the last of a partition needs padding, and that one is padded
to the next power of two only.

The ids are made once and written to the shared folder; sampling for the ranges reads only the keys. Ties on the key
(copies, short texts) are parted by a hash of the document, so that a hot group spreads over range partitions.

Defined results: a null or empty text is the end id alone, a piece of length 1. A text of any length is tokenized whole and
cut into as many pieces as it needs. Rows with the same doc_id are packed as
documents of their own. A null doc_id is packed like any other. Extra columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bpe import codec, texts_of
from quillspark.llm.common import Scratch, map_slices
from quillspark.llm.hilbert import hilbert_keys, quantised

LENGTH, END, DIMENSIONS, BITS, BUCKETS = 4096, 2, 4, 15, 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"


def curve_keys(ids: np.ndarray, sizes: np.ndarray, dimensions: int = DIMENSIONS, bits: int = BITS, buckets: int = BUCKETS) -> np.ndarray:
    """Hilbert keys of documents whose ids lie end to end: counts hashed to `buckets`, roots taken, scaled to unit length, projected."""
    table = _projection(dimensions, buckets)
    hashed = ((ids.astype(np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(16)).astype(np.int64) & (buckets - 1)
    ends = np.cumsum(sizes)
    out = np.zeros((len(sizes), dimensions))
    for s in range(0, len(sizes), 1024):  # a bounded table of counts
        n = sizes[s : s + 1024]
        part = hashed[ends[s] - sizes[s] : ends[s + len(n) - 1]]
        counts = np.bincount(np.repeat(np.arange(len(n)) * buckets, n) + part, minlength=len(n) * buckets).reshape(len(n), buckets)
        out[s : s + len(n)] = np.sqrt(counts) @ table / np.sqrt(np.maximum(n, 1))[:, None]
    return hilbert_keys(quantised(out, bits), bits)


def _projection(dimensions: int, buckets: int) -> np.ndarray:
    found = _projection.__dict__.setdefault("made", {})
    if (dimensions, buckets) not in found:
        found[dimensions, buckets] = np.random.default_rng(11).standard_normal((buckets, dimensions))
    return found[dimensions, buckets]


def _tokenised(path: str, end: int):
    def rows(batch):
        own, last = codec(path), end.to_bytes(4, "little")
        parts = own.encode(texts_of(batch.column("text")))
        sizes = np.array([len(x) // 4 + 1 for x in parts])
        ids = np.frombuffer(last.join([*parts, b""]), "<u4")
        wide = np.dtype("<u4" if len(own.table) > 65536 else "<u2")
        packed, ends = ids.astype(wide).tobytes(), (np.cumsum(sizes) * wide.itemsize).tolist()
        columns = [batch.column("doc_id"), pa.array(curve_keys(ids, sizes)), batch.column("tie"), pa.array([packed[a:b] for a, b in zip([0, *ends], ends)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "curve_key", "tie", "ids"])

    return rows


def _pack(length: int, wide: str):
    def run(batches):
        filled, sequence, rows = 0, None, []

        for batch in batches:
            for doc, part, ids in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("ids").to_pylist()):
                if sequence is None:
                    sequence = part << 36
                all_ids = np.frombuffer(ids, wide).astype("<u4")
                n, start = len(all_ids), 0
                while start < n:
                    if filled == length:
                        filled, sequence = 0, sequence + 1
                    take = min(n - start, length - filled)
                    rows.append((doc, start, take, zlib.crc32(all_ids[start : start + take].tobytes()), n, sequence, filled))
                    filled, start = filled + take, start + take
            if len(rows) > 20000:  # all but the open sequence's pieces are final
                open_ = next(i for i, r in enumerate(rows) if r[5] == rows[-1][5])
                ready, rows = rows[:open_], rows[open_:]
                if ready:
                    yield _batch([(*r, length) for r in ready])
        if rows:
            last = 1 << max(0, filled - 1).bit_length()
            yield _batch([(*r, length if r[5] != rows[-1][5] else last) for r in rows])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of all documents: where each lies in its document and in its sequence."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", F.length("text")).alias("tie"))
    ids = map_slices(own, "text", "doc_id long, curve_key long, tie long, ids binary", _tokenised(tokenizer, end), 8 << 20)
    made = Scratch(spark, "pack").write(ids, "ids")
    wide = "<u4" if len(codec(tokenizer).table) > 65536 else "<u2"
    along = made.repartitionByRange("curve_key", "tie").sortWithinPartitions("curve_key", "tie")
    return along.select("doc_id", "ids", F.spark_partition_id().cast("long").alias("part")).mapInArrow(_pack(length, wide), PIECES)
