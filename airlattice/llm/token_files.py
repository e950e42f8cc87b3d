"""Token ids in seekable files of independent zstandard frames.

A file is frames, each with its own checksum and holding the ids of whole documents, then a seek
table. The table is itself a skippable frame, so any zstandard reader can unpack a whole file; a
reader that knows the table unpacks only the frames of the documents it was asked for.

    frame*      ids, little-endian, 2 or 4 bytes each
    table       0x184D2A5E, size (uint32 each), then
      frames    per frame: packed bytes, unpacked bytes, low half of the XXH64 of the unpacked bytes (uint32 each)
      docs      per document: doc_id (int64), ids (int64), frame (uint32), 1 if doc_id is null (uint32)
      footer    file number (int64), frames, docs, bytes per id (uint32 each), 8 magic bytes

The last magic byte is a line end. Files are written by Spark's text writer, one row each, and its
line separator is that byte; so files go to any store that Spark can write, by its commit protocol.

Cases: a null or empty text holds the end token alone; repeated ids are kept next to each other,
ordered by text; documents without an id come first; an empty table gives no files and reads as no
rows. A damaged frame or table is an error.
"""

import math
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airlattice.joins import broadcast_if_small
from airlattice.llm.common import return_memory
from airlattice.llm.encode import batch_slices, encoder, vocabulary

SKIPPABLE = 0x184D2A5E
MAGIC = b"ATOKENS\n"
FOOTER = struct.Struct("<qIII")
FRAMES = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
DOCS = np.dtype([("doc_id", "<i8"), ("n", "<i8"), ("frame", "<u4"), ("null", "<u4")])
# Ids of a frame (a longer document has a frame of its own), and text bytes behind one file.
FRAME_IDS = 1 << 16
FILE_TEXT_BYTES = 16 << 20
LEVEL = 3
# Bytes of ids that a reading task holds before it hands them on.
READ_BYTES = 4 << 20
MAX_BROADCAST_FILES = 500_000
TABLE = "doc_id long, file long, place long, start_in_file long, n_tokens long, ids binary"


def check_of(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FileBuilder:
    """Collects documents in order and gives the bytes of their file."""

    def __init__(self, number: int, width: int, frame_ids: int = FRAME_IDS):
        self.number, self.width, self.frame_ids = number, width, frame_ids
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.body, self.frames, self.docs = [], [], []
        self.open, self.open_ids = [], 0

    def add(self, doc_id, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        n = len(ids) // 4
        if self.open and self.open_ids + n > self.frame_ids:
            self._close()
        self.docs.append((doc_id or 0, n, len(self.frames), doc_id is None))
        self.open.append(ids)
        self.open_ids += n

    def _close(self) -> None:
        data = np.frombuffer(b"".join(self.open), "<u4").astype(f"<u{self.width}").tobytes()
        packed = self.packer.compress(data)
        self.body.append(packed)
        self.frames.append((len(packed), len(data), check_of(data)))
        self.open, self.open_ids = [], 0

    def finish(self, without: int = 0) -> bytes:
        """The file, but for the last ``without`` bytes of the footer."""
        if self.open:
            self._close()
        frames, docs = np.array(self.frames, FRAMES), np.array(self.docs, DOCS)
        footer = FOOTER.pack(self.number, len(frames), len(docs), self.width) + MAGIC
        table = frames.tobytes() + docs.tobytes() + footer
        head = struct.pack("<II", SKIPPABLE, len(table))
        return b"".join([*self.body, head, table[: len(table) - without]])


def read_table(content: bytes):
    """number, width, frames, docs of a file; content may be its tail as long as the table is in it."""
    tail = FOOTER.size + len(MAGIC)
    if len(content) < tail + 8 or content[-len(MAGIC) :] != MAGIC:
        raise ValueError("no seek table at the end of the file")
    number, n_frames, n_docs, width = FOOTER.unpack_from(content, len(content) - tail)
    size = n_frames * FRAMES.itemsize + n_docs * DOCS.itemsize + tail
    at = len(content) - size
    if at < 8 or struct.unpack_from("<II", content, at - 8) != (SKIPPABLE, size):
        raise ValueError("the seek table does not fit the file")
    frames = np.frombuffer(content, FRAMES, n_frames, at)
    docs = np.frombuffer(content, DOCS, n_docs, at + n_frames * FRAMES.itemsize)
    return number, width, frames, docs


def read_documents(content: bytes, wanted=None):
    """(place, doc_id, ids before it in the file, ids as unsigned 32-bit bytes) of the wanted documents.

    Only frames that hold one of them are unpacked, one at a time, and each is checked.
    """
    _, width, frames, docs = read_table(content)
    begins = np.concatenate([[0], np.cumsum(frames["packed"], dtype=np.int64)])
    before = np.concatenate([[0], np.cumsum(docs["n"])])
    unpacker = zstandard.ZstdDecompressor()
    pick = np.arange(len(docs))
    if wanted is not None:
        pick = pick[np.isin(docs["doc_id"], np.array(sorted(wanted), np.int64)) & (docs["null"] == 0)]
    first_doc = np.searchsorted(docs["frame"], np.arange(len(frames)))
    unpacked, data = -1, None
    for place in pick.tolist():
        frame = int(docs["frame"][place])
        if frame != unpacked:
            packed = content[begins[frame] : begins[frame + 1]]
            raw = unpacker.decompress(packed, max_output_size=int(frames["size"][frame]))
            if check_of(raw) != int(frames["check"][frame]):
                raise ValueError(f"frame {frame} does not match its checksum")
            unpacked, data = frame, np.frombuffer(raw, f"<u{width}")
        start = int(before[place] - before[first_doc[frame]])
        ids = data[start : start + int(docs["n"][place])].astype("<u4").tobytes()
        yield place, None if docs["null"][place] else int(docs["doc_id"][place]), int(before[place]), ids


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 0, file_text_bytes: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write their files in ascending order of doc_id.

    Texts are dealt by range of doc_id (bounds from the ids alone) and encoded where they arrive,
    so they are shuffled once and ids never are. ``file_text_bytes`` of text stand behind a file,
    which a task holds while it is made.
    """
    spark = docs.sparkSession
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = columns.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = vocabulary(spark, tokenizer_path)
    end = b"" if end_id is None else np.array([end_id], np.uint32).tobytes()

    def run(batches):
        return_memory()
        own, file = encoder(words), None
        width = 2 if max(own.tokenizer.get_vocab_size(), end_id or 0) <= 1 << 16 else 4
        for batch in batches:
            for part in batch_slices(batch):
                if file is None:
                    file = FileBuilder(TaskContext.get().partitionId(), width)
                doc_ids, texts = (part.column(n).to_pylist() for n in ("doc_id", "text"))
                for doc_id, ids in zip(doc_ids, own.encode([t or "" for t in texts])):
                    file.add(doc_id, ids + end)
        if file is not None:
            # The writer ends the row with the last byte.
            yield pa.RecordBatch.from_arrays([pa.array([file.finish(without=1)], pa.binary())], ["content"])

    ranged = columns.repartitionByRange(max(1, math.ceil(size / (file_text_bytes or FILE_TEXT_BYTES))), "doc_id").sortWithinPartitions("doc_id", "text")
    files = ranged.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    files.write.option("lineSep", "\n").option("compression", "none").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")


def read(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """Documents of the files: doc_id, file and place in it, ids before it in the file, their number, ids.

    ``wanted``: the doc_ids asked for; frames without any of them stay packed.
    """
    keys = None if wanted is None else set(wanted)

    def run(batches):
        return_memory()
        for batch in batches:
            for n in range(batch.num_rows):
                content = batch.column("content")[n].as_buffer().to_pybytes()
                number = read_table(content)[0]
                rows, held = [], 0
                for place, doc_id, start, ids in read_documents(content, keys):
                    rows.append((doc_id, number, place, start, len(ids) // 4, ids))
                    held += len(ids)
                    if held > READ_BYTES:
                        yield _rows(rows)
                        rows, held = [], 0
                yield _rows(rows)

    return _files(spark, path).mapInArrow(run, TABLE)


def _rows(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = [pa.int64()] * 5 + [pa.binary()]
    names = [part.split()[0] for part in TABLE.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """file, file_start: ids in all files before it, from the seek tables alone. One row per file."""

    def run(batches):
        for batch in batches:
            found = [read_table(batch.column("content")[n].as_buffer().to_pybytes()) for n in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([int(f[3]["n"].sum()) for f in found], pa.int64())],
                ["file", "n"],
            )

    totals = _files(spark, path).mapInArrow(run, "file long, n long")
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def read_with_starts(spark: SparkSession, path: str) -> DataFrame:
    """``read`` with ``start``: the ids of all documents before it, over all files. Files are few and
    large; their starts are broadcast after a look at their number, so ids are not shuffled."""
    starts = broadcast_if_small(file_starts(spark, path), MAX_BROADCAST_FILES)
    return read(spark, path).join(starts, "file").withColumn("start", F.col("file_start") + F.col("start_in_file"))
