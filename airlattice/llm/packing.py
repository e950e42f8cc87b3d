"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces of binary lengths: as many of the longest as fit, then one
per set bit of the rest, longest first. Pieces of equal length share a bucket, and every piece is a
sequence of its own, so no sequence crosses documents and none needs padding. Sequences are
numbered bucket by bucket, longest bucket first.

Cases: a null or empty text is the end token alone, one piece of length 1; repeated rows and ids
are packed each; an end token of None is left out, and then such a text has no piece; an empty
table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.llm.encode import batch_slices, encoder, vocabulary
from airlattice.llm.numbering import running_total

MAX_LENGTH = 2048


def binary_lengths(n: int, longest: int) -> list[int]:
    """``n`` as pieces: multiples of the longest power of two, then the bits of the rest."""
    found = [longest] * (n // longest)
    rest = n % longest
    found += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return found


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, max_length: int = MAX_LENGTH) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens: one row per piece."""
    longest = 1 << (max_length.bit_length() - 1)
    words = vocabulary(docs.sparkSession, tokenizer_path)
    end = b"" if end_id is None else np.array([end_id], np.uint32).tobytes()
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long"

    def run(batches):
        own = encoder(words)
        for batch in batches:
            for part in batch_slices(batch):
                ids, starts, sizes, data, totals = [], [], [], [], []
                doc_ids, texts = (part.column(n).to_pylist() for n in ("doc_id", "text"))
                for doc_id, found in zip(doc_ids, own.encode([t or "" for t in texts])):
                    found += end
                    total, at = len(found) // 4, 0
                    for size in binary_lengths(total, longest):
                        ids.append(doc_id)
                        starts.append(at)
                        sizes.append(size)
                        data.append(found[4 * at : 4 * (at + size)])
                        totals.append(total)
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary()), pa.array(totals, pa.int64())],
                    ["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, schema)


def number_sequences(found: DataFrame) -> DataFrame:
    """Pieces with sequence_id and offset. What else the rows carry is shuffled with them once, so
    leave out ``ids`` if a digest will do."""
    order = [F.col("length").desc(), F.col("doc_id").asc(), F.col("start").asc()]
    return running_total(found, order, F.lit(1).cast("long"), "sequence_id").withColumn("offset", F.lit(0).cast("long"))
