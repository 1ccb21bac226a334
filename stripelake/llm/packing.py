"""Packing by power-of-two decomposition.

A document of n ids is cut into as many pieces of ``max_len`` as fit and one piece for each bit of
the rest, longest first.  Every piece is a whole sequence of a power-of-two length; equal lengths
form a bucket (the high bits of sequence_id), from which batches of one length are drawn.  No
sequence crosses documents and none is padded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import cut, release
from .tokens import encode, with_end


#: Bytes of text that are encoded at once: encoding takes some sixty times its text, and every core has a worker.
SLICE = 256 << 10


def pieces(n: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of document, start, length) of each piece, for documents of n ids each."""
    whole = n // max_len
    bits = 1 << np.arange(max_len.bit_length() - 2, -1, -1)
    has = (n[:, None] & bits) > 0
    count = whole + has.sum(axis=1)
    doc = np.repeat(np.arange(len(n)), count)
    length = np.full(len(doc), max_len, dtype=np.int64)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length[nth >= whole[doc]] = np.broadcast_to(bits, has.shape)[has]
    ends = np.cumsum(length)
    before = np.concatenate(([0], np.cumsum(n)))[:-1]
    return doc, ends - length - before[doc], length


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, max_len: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: (id_col, start, length, ids, doc_tokens, sequence_id, offset).

    ids are the piece's token ids as little-endian unsigned 32-bit integers; max_len is a power of
    two.  A null or empty text is the end id alone, one piece of length 1.  Every row of the input
    is packed, also repeated ones and those without an id.  sequence_id holds the bucket (log2 of
    the length) in bits 58-62, the input partition in bits 34-57 and a running number below.  Other
    columns are ignored.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    log2 = {1 << b: b for b in range(max_len.bit_length())}

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in cut(batches, "text", SLICE):
            ids, upto = with_end(*encode(batch.column("text").to_pylist(), tokenizer), end_id)
            n = np.diff(upto)
            doc, start, length = pieces(n, max_len)
            data = ids.astype("<u4").tobytes()
            first = (upto[doc] + start) * 4
            seq = np.array([log2[x] for x in length.tolist()], dtype=np.int64) << 58 | part << 34 | np.arange(at, at + len(doc))
            at += len(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([data[a : a + 4 * b] for a, b in zip(first.tolist(), length.tolist())], type=pa.binary()), pa.array(n[doc]), pa.array(seq), pa.array(np.zeros(len(doc), dtype=np.int64))],
                names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
        release()

    out = rows.mapInArrow(run, "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
