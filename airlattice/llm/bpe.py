"""BPE encoding with content-defined chunks that are encoded once.

A rolling hash over the bytes cuts texts where the content says so, so passages that documents
share fall into the same chunks wherever they stand. A chunk is encoded when it is first met and
its ids are used again for every other document of the worker's tasks. Chunks know nothing of
their neighbours, so each join is then repaired: the text from a word start before it to one after
it is encoded again, and the window grows until both its ends are token ends of the chunks that
it meets; what lies between is replaced.

Such a word start is an ASCII space after an ASCII character that is not white space. No word of
the tokenizer spans it, whatever the context, which makes agreement there final.

Cases: a null or empty text has no ids and decodes to an empty text; special tokens' strings in a
text are their id, as the library has it; repeated rows and ids give a row each; an empty table
gives no rows.
"""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.llm.common import byte_texts, return_memory
from airlattice.llm.encode import batch_slices, encoder, vocabulary

# The hash covers this many bytes; a chunk ends where its low bits are zero (one place in 256).
WINDOW = 16
MASK = (1 << 8) - 1
SHORTEST, LONGEST = 64, 2048
# Bytes of chunk texts kept per generation in a worker.
KEPT_BYTES = 6 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_PLAIN = np.array([b < 128 and not _SPACE[b] for b in range(256)])


def _gear() -> np.ndarray:
    """A fixed pseudo-random number per byte (splitmix of the byte value)."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))).astype(np.uint32)


GEAR = _gear()


def cut_places(text: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes. They depend on the last bytes only (apart from the
    shortest and longest length), and never split a character."""
    n = len(text)
    if n <= SHORTEST:
        return [n] if n else []
    gear = GEAR[text]
    rolled = gear.copy()
    for shift in range(1, min(WINDOW, n)):
        rolled[shift:] += gear[:-shift] << np.uint32(shift)
    # The top bits have seen the whole window.
    candidates = np.flatnonzero((rolled >> np.uint32(WINDOW - 1) & np.uint32(MASK)) == 0) + 1
    candidates = candidates.tolist()
    ends, last = [], 0
    for place in [*candidates, n]:
        while place - last > LONGEST:
            last = _character_start(text, last + LONGEST)
            ends.append(last)
        if place - last >= SHORTEST and place < n:
            place = _character_start(text, place)
            if last < place < n:
                ends.append(place)
                last = place
    ends.append(n)
    return ends


def _character_start(text: np.ndarray, place: int) -> int:
    while place < len(text) and text[place] & 0xC0 == 0x80:
        place += 1
    return place


class ChunkEncoder:
    """Texts (UTF-8 bytes) to ids by chunks, for one worker."""

    def __init__(self, own):
        self.own = own
        words = own.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = _token_bytes(words, set(own.tokenizer.get_added_tokens_decoder()))
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.chunks, self.older, self.kept = {}, {}, 0

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        return self.own.encode([p.decode("utf-8", "replace") for p in parts])

    def _learn(self, wanted: set) -> None:
        fresh = []
        for chunk in wanted.difference(self.chunks):
            ids = self.older.get(chunk)
            if ids is None:
                fresh.append(chunk)
            else:
                self.chunks[chunk] = ids
        self.chunks.update(zip(fresh, self._encode(fresh)))
        self.kept += sum(map(len, fresh))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        cut, wanted = [], set()
        for text in texts:
            ends = cut_places(np.frombuffer(text, np.uint8))
            chunks = [text[a:b] for a, b in zip([0, *ends], ends)]
            wanted.update(chunks)
            cut.append((ends, chunks))
        self._learn(wanted)
        joined, distinct = [], set()
        for text, (ends, chunks) in zip(texts, cut):
            ids = np.frombuffer(b"".join([self.chunks[c] for c in chunks]), np.uint32)
            windows = self._windows(text, ends, ids) if len(ends) > 1 else []
            distinct.update([text[a:b] for a, b, _, _ in windows])
            joined.append((ids, windows))
        # Windows are encoded again for all texts of the slice at once.
        repairs = dict(zip(distinct, self._encode(list(distinct))))
        if self.kept > KEPT_BYTES:
            self.chunks, self.older, self.kept = {}, self.chunks, 0
        return [self._repaired(text, ids, windows, repairs) for text, (ids, windows) in zip(texts, joined)]

    def _windows(self, text: bytes, ends: list[int], ids: np.ndarray) -> list[tuple]:
        """(from, to) in bytes around the joins, and the tokens of the chunks that end before and by them.

        A window's ends are word starts where a token of the chunks ends too; it is widened until
        that is so. Windows that meet are one.
        """
        view = np.frombuffer(text, np.uint8)
        starts = np.flatnonzero((view[1:] == 32) & _PLAIN[view[:-1]]) + 1
        token_ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        agreed = starts[token_ends[np.searchsorted(token_ends, starts)] == starts]
        agreed = np.concatenate([[0], agreed, [len(text)]])
        joins = np.array(ends[:-1])
        begins = agreed[np.searchsorted(agreed, joins, side="right") - 1]
        stops = agreed[np.searchsorted(agreed, joins, side="left")]
        inside = begins < stops  # else the join is agreed as it is
        windows: list = []
        for a, b in zip(begins[inside].tolist(), stops[inside].tolist()):
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(b, windows[-1][1])
            else:
                windows.append([a, b])
        places = np.searchsorted(token_ends, np.array(windows, np.int64).reshape(-1, 2)).tolist()
        return [(a, b, i, j) for (a, b), (i, j) in zip(windows, places)]

    @staticmethod
    def _repaired(text: bytes, ids: np.ndarray, windows: list[tuple], repairs: dict) -> np.ndarray:
        """The chunks' ids outside the windows, and those of the windows."""
        if not windows:
            return ids
        out, last = [], 0
        for a, b, i, j in windows:
            out.append(ids[last:i].tobytes())
            out.append(repairs[text[a:b]])
            last = j
        out.append(ids[last:].tobytes())
        return np.frombuffer(b"".join(out), np.uint32)


def _token_bytes(words: dict[str, int], special: set[int]) -> list[bytes]:
    """The bytes of each id. Byte-level vocabularies write a byte as a printable character: itself
    where it is one, else one from 256 on, in order."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(itself)]
    byte_of = {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(other)}
    table = [b""] * (max(words.values()) + 1)
    for word, number in words.items():
        table[number] = word.encode() if number in special else bytes(byte_of[c] for c in word)
    return table


def is_byte_level(vocabulary_text: str) -> bool:
    kind = json.loads(vocabulary_text).get("pre_tokenizer") or {}
    return kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space")


def encode(docs: DataFrame, tokenizer_path: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids: the ids of each whole text; with ``decoded`` also text: what the ids decode to, in the
    same pass, so that one worker serves a task."""
    words = vocabulary(docs.sparkSession, tokenizer_path)
    if not is_byte_level(words.value):
        raise ValueError("chunk reuse needs a byte-level vocabulary that adds no leading space")

    def run(batches):
        return_memory()
        own = _chunk_encoder(words)
        for batch in batches:
            for piece in batch_slices(batch):
                found = own.encode(byte_texts(piece.column("text")))
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
                arrays = [piece.column("doc_id"), ids]
                if decoded:
                    arrays.append(_texts(own.token_bytes, [x.tolist() for x in found]))
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "ids", "text"] if decoded else ["doc_id", "ids"]
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, ids array<int>" + (", text string" if decoded else ""))


def _texts(table: list[bytes], lists: list[list[int]]) -> pa.Array:
    """Ids to text by the bytes of each id."""
    return pa.array([b"".join([table[i] for i in ids]).decode("utf-8", "replace") for ids in lists], pa.string())


_chunk_encoders: dict = {}


def _chunk_encoder(words) -> ChunkEncoder:
    if words.value not in _chunk_encoders:
        _chunk_encoders.clear()
        _chunk_encoders[words.value] = ChunkEncoder(encoder(words))
    return _chunk_encoders[words.value]


def decode(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids, text: ids back to texts, special tokens as their strings; bytes that are no text
    become replacement characters, as the library has it."""
    words = vocabulary(tokens.sparkSession, tokenizer_path)

    def run(batches):
        return_memory()
        table = _chunk_encoder(words).token_bytes
        for batch in batches:
            for piece in batch_slices(batch):
                texts = _texts(table, [x or [] for x in piece.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("ids"), texts], ["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
