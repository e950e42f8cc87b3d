"""Language-model scores by a probabilistic suffix tree over words.

A state is a context of up to MAX_DEPTH words. It is retained if it was seen often enough and its
next-word distribution diverges from that of its suffix (the state's parent); so contexts have
variable length, and every suffix of a retained context is retained. The distribution of a state
discounts the followers that it saw twice or more and gives the rest to its parent's, down to the
root, which is the base distribution. A text is scored by the longest suffix state at each word.

The model is as large as the corpus makes it and is never held in one place. Documents are put
into blocks of word numbers, written once. For each level, blocks send their distinct keys (words,
contexts with a next word, contexts) with their own counts to buckets of a hash; buckets add up and
answer each block in its own order. A frequent word or context is one key per block, so there are
no hot groups, and tokens themselves never move.

Cases: a null or empty text is the end token alone; repeated rows count and are scored each; a row
without an id counts as having the id of empty text, which trains; with nothing to learn from,
scores are those of the empty base; an empty table gives no rows. Words are 64-bit hashes at first;
buckets then number those that were seen twice, and contexts that were seen often enough, and longer
keys are pairs of such numbers, exact and shorter (pairs beyond 64 bits are hashed).
"""

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.llm.common import byte_texts, fold, return_memory, shared_folder

MAX_DEPTH = 3
# Occurrences that a context needs, the discount of its followers, and the divergence (nats per
# occurrence, after a penalty per follower) from its parent that it needs.
MIN_CONTEXT, DISCOUNT, MIN_DIVERGENCE = 8, 0.75, 0.02
BLOCK_TOKENS = 1 << 19
# Text whose words are cut at once, within a core's cache.
PIECE_BYTES = 1 << 16
# Tokens behind one bucket: a bucket's keys are held by one task.
BUCKET_TOKENS = 1 << 20
LEAST_BUCKETS = 16
# About this many bytes of text stand behind one partition of blocks.
PARTITION_BYTES = 8 << 20

# The end token is hashed as a text that no word can be.
END = xxhash.xxh64_intdigest(b" ")
# Words longer than this are hashed whole.
LONG_WORD = 64


# --- arrays as bytes ------------------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Integers in as few bytes as they need, floats as they are; compressed."""
    if values.dtype.kind in "iu" and len(values):
        values = values.astype(np.min_scalar_type(int(values.max())))
    return values.dtype.char.encode() + zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), np.dtype(data[:1].decode()))


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte: of each, the upper bytes are zero."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranked(keys: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What np.unique gives with index and inverse, without the stable sort that it needs for the index. Keys of
    so few ``bits`` that a place fits below them are sorted together with it, which is faster still."""
    place_bits = np.uint64(len(keys).bit_length())
    if bits + int(place_bits) <= 64:
        both = np.sort((keys << place_bits) | np.arange(len(keys), dtype=np.uint64))
        order, ascending = (both & np.uint64((1 << int(place_bits)) - 1)).astype(np.int64), both >> place_bits
    else:
        order = np.argsort(keys)
        ascending = keys[order]
    begins = np.ones(len(keys), bool)
    begins[1:] = ascending[1:] != ascending[:-1]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(begins, dtype=np.int32) - 1
    starts = np.flatnonzero(begins)
    first = np.minimum.reduceat(order, starts) if len(starts) else starts
    return ascending[starts], first, place


# --- blocks ---------------------------------------------------------------------------------


# A-Z in lower case, white space as blanks.
_FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
# Every byte's own 64-bit number, and powers of an odd base and of its inverse modulo 2^64.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_powers: dict = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers at least; only those of windows of the usual size are kept."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, PIECE_BYTES), base, np.uint64)
        found[0] = 1
        found = np.multiply.accumulate(found)
        if n <= PIECE_BYTES:
            _powers[base] = found
    return found


def windows(text: bytes, most: int):
    """Parts of a text that begins and ends with a blank, each of which does so too; as many of up to ``most``
    bytes as words allow."""
    at, last = 0, len(text) - 1
    while at < last:
        end = last if last < at + most else text.rfind(b" ", at + 1, at + most)
        if end < 0:
            end = text.index(b" ", at + most)
        yield at, text[at : end + 1]
        at = end


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text of words and blanks, with a blank at either end, start, and their hashes: of a word of
    up to LONG_WORD bytes the sum of its bytes' numbers by powers of a base, from running sums of the text's."""
    found = []
    for at, part in windows(text, PIECE_BYTES):
        data = np.frombuffer(part, np.uint8)
        blank = data == 32
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        sums = np.cumsum(_BYTE[data] * _powers_of(_BASE, len(data))[: len(data)])
        back = _powers_of(pow(_BASE, -1, 1 << 64), len(data))
        hashes = mixed((sums[ends - 1] - sums[starts - 1]) * back[starts])
        for n in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            hashes[n] = xxhash.xxh64_intdigest(part[starts[n] : ends[n]])
        found.append((starts + at, hashes))
    return tuple(np.concatenate(x) for x in zip(*found))


class BlockBuilder:
    def __init__(self, number: int):
        self.number = number
        self.doc_ids, self.train, self.sizes, self.hashes, self.tokens = [], [], [], [], 0

    def add(self, doc_ids: list, train: list, texts: list[bytes]) -> None:
        """A-Z are lower-cased and words cut at ASCII white space, for some texts at a time."""
        starts, hashes = word_hashes(b"".join([b" ", b" ".join(texts), b" "]).translate(_FOLDED))
        words_to = np.searchsorted(starts, np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))))
        self.hashes.append(np.insert(hashes, words_to, np.uint64(END)))
        self.doc_ids += doc_ids
        self.train += train
        self.sizes += (np.diff(words_to, prepend=0) + 1).tolist()
        self.tokens += len(hashes) + len(texts)

    def row(self) -> dict:
        """Words are numbered in the order of their hashes."""
        distinct, _, tokens = ranked(np.concatenate(self.hashes))
        counted = tokens[np.repeat(np.array(self.train, bool), self.sizes)]
        return {
            "block": self.number,
            "doc_ids": self.doc_ids,
            "train": self.train,
            "sizes": self.sizes,
            "tokens": packed(tokens),
            "words": packed_keys(distinct),
            "counts": packed(np.bincount(counted, minlength=len(distinct))),
            "n_tokens": self.tokens,
        }


def pieces(texts: list[bytes], most: int):
    """Slices of ``texts`` of up to ``most`` bytes and ends, or of one text."""
    begin = size = 0
    for n, text in enumerate(texts):
        if n > begin and size + len(text) + 1 > most:
            yield slice(begin, n)
            begin, size = n, 0
        size += len(text) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))


BLOCK = "block long, doc_ids array<long>, train array<boolean>, sizes array<int>, tokens binary, words binary, counts binary, n_tokens long"


def write_blocks(docs: DataFrame, train) -> tuple[DataFrame, int]:
    """The blocks of ``docs``, written once and dealt by block number, and the number of parts."""
    spark = docs.sparkSession
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), F.col("text").cast("string").alias("text"))
    kinds = pa.schema(
        [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32()))]
        + [("tokens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("n_tokens", pa.int64())]
    )

    def run(batches):
        return_memory()
        number = TaskContext.get().partitionId() << 20
        block = BlockBuilder(number)
        for batch in batches:
            doc_ids, trains, texts = batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), byte_texts(batch.column("text"))
            for part in pieces(texts, min(PIECE_BYTES, BLOCK_TOKENS)):
                block.add(doc_ids[part], trains[part], texts[part])
                if block.tokens >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pylist([block.row()], kinds)
                    number += 1
                    block = BlockBuilder(number)
        if block.doc_ids:
            yield pa.RecordBatch.from_pylist([block.row()], kinds)

    size = columns.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PARTITION_BYTES))
    return _by_block(columns.mapInArrow(run, BLOCK), parts), parts


def _by_block(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` written in the shared folder as a table bucketed by block: joins of such tables by block
    move nothing."""
    spark = rows.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    path = shared_folder(spark, "blocks")
    rows.write.bucketBy(parts, "block").option("path", path).saveAsTable(name)
    return spark.table(name)


# --- exchange -------------------------------------------------------------------------------

ASKED = "bucket int, block long, keys binary, columns array<binary>"
ANSWERED = "block long, bucket int, columns array<binary>, first binary, ranks long, total long, positive long"


def requests(block: int, keys: np.ndarray, columns: list[np.ndarray], buckets: int, span: int = 1 << 64):
    """Rows that ask the buckets for the sums of ``columns`` by key; keys are distinct, ascending and below ``span``,
    and a bucket is a range of them."""
    ends = [0, *np.searchsorted(keys, np.array([-(-span * b // buckets) for b in range(1, buckets)], np.uint64)).tolist(), len(keys)]
    for b in range(buckets):
        part = slice(ends[b], ends[b + 1])
        if part.start < part.stop:
            yield {"bucket": b, "block": block, "keys": packed_keys(keys[part]), "columns": [packed(c[part]) for c in columns]}


def scrambled(x: np.ndarray, bits: int) -> np.ndarray:
    """A permutation of the numbers of so many bits that spreads them evenly."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x * np.uint64(odd)) & mask
        x ^= x >> half
    return (x * np.uint64(0x9E3779B97F4A7C15)) & mask


def _add_up(asked: pa.Table, step: int = 0) -> pa.Table:
    """Sums by key over all blocks of a bucket. ``first`` marks, for each key, one block that has it;
    total and positive (of the first column) are counted once, in the bucket's first row.

    Blocks hear what they use: of contexts with their next word, the counts from two on and the marks of
    these; of contexts, which of them are states, then mass and followers of the states alone. Of what later
    keys are made of (words that were seen twice, contexts that were seen often enough) they also hear the
    rank among such keys of the bucket; ``ranks`` is their number, in every row.
    """
    rows = asked.sort_by("block").to_pylist()
    keys = [unpacked_keys(r["keys"]) for r in rows]
    sizes = [len(k) for k in keys]
    keys = np.concatenate(keys)
    ends = np.cumsum(sizes)
    distinct, first, place = ranked(keys)
    judging = step > 0 and step % 2 == 0
    sums = []
    for n in range(len(rows[0]["columns"]) - judging):
        values = [unpacked(r["columns"][n]) for r in rows]
        whole = all(v.dtype.kind in "iu" for v in values)
        total = np.bincount(place, np.concatenate(values), minlength=len(distinct))
        sums.append(total.astype(np.int64) if whole else total)
    if judging:
        # All blocks know how often a context occurs, and say the same.
        often = np.concatenate([unpacked(r["columns"][-1]) for r in rows])[first]
        states = sums[2] >= MIN_DIVERGENCE * often
        first = first[:0]
    elif step:
        sums[0][sums[0] < 2] = 0
        first = first[sums[0] > 0]
    is_first = np.zeros(len(keys), bool)
    is_first[first] = True
    used = np.zeros(len(distinct), bool) if judging else sums[0] >= (MIN_CONTEXT if step else 2)
    rank = np.cumsum(used) - 1
    found = []
    for i, (row, end) in enumerate(zip(rows, ends.tolist())):
        own = slice(end - sizes[i], end)
        if judging:
            kept = states[place[own]]
            columns = [kept.astype(np.uint8), *(s[place[own][kept]] for s in sums[:2])]
        else:
            at = place[own]
            columns = [*(s[at] for s in sums), np.diff(rank[at[used[at]]], prepend=0)]
        found.append(
            {
                "block": row["block"],
                "bucket": row["bucket"],
                "columns": [packed(c) for c in columns],
                "first": b"" if judging else np.packbits(is_first[own]).tobytes(),
                "ranks": int(used.sum()),
                "total": int(sums[0].sum()) if i == 0 else 0,
                "positive": int((sums[0] > 0).sum()) if i == 0 else 0,
            }
        )
    return pa.Table.from_pylist(found, _answer_kinds())


def _answer_kinds() -> pa.Schema:
    return pa.schema(
        [("block", pa.int64()), ("bucket", pa.int32()), ("columns", pa.list_(pa.binary())), ("first", pa.binary())]
        + [("ranks", pa.int64()), ("total", pa.int64()), ("positive", pa.int64())]
    )


def exchanged(asked: DataFrame, parts: int, step: int) -> DataFrame:
    """The answers of a step, written once beside the blocks."""

    def add_up(table: pa.Table) -> pa.Table:
        return _add_up(table, step)

    return _by_block(asked.groupBy("bucket").applyInArrow(add_up, ANSWERED).repartition(parts, "block"), parts)


# --- a block and what it knows --------------------------------------------------------------


def answered(rows: list[dict] | None, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A block's answers in the order in which it asked for ``n`` keys: columns, and the first mark."""
    if not rows:
        return [np.zeros(n, np.int64)] * 3, np.zeros(n, bool)
    rows = sorted(rows, key=lambda r: r["bucket"])
    parts = [[unpacked(c) for c in r["columns"]] for r in rows]
    columns = [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))]
    if not rows[0]["first"]:
        return columns, np.zeros(0, bool)
    marks = [np.unpackbits(np.frombuffer(r["first"], np.uint8))[: len(p[0])] for r, p in zip(rows, parts)]
    return columns, np.concatenate(marks).astype(bool)


def identities(rows: list[dict] | None, counts: np.ndarray, least: int, ranks: int) -> np.ndarray:
    """Numbers by which all blocks know the keys that were seen ``least`` times; 0 for others. A bucket's keys
    have the ``ranks`` numbers from its own multiple of these on."""
    found = np.zeros(len(counts), np.uint64)
    if rows:
        rows = sorted(rows, key=lambda r: r["bucket"])
        own = [np.cumsum(unpacked(r["columns"][-1]), dtype=np.uint64) + np.uint64(r["bucket"] * ranks) for r in rows]
        found[counts >= least] = np.concatenate(own)
    return found


class Walk:
    """A block's tokens with the states that are known so far.

    The steps of level k are 2k - 1 (contexts with their next word) and 2k (contexts); step 0 are the
    words. ``ask(step)`` gives the keys and columns to send; ``scores()`` the end result. A context
    with its next word is the next level's context one place on, so a level's keys are found by
    number among those of the level before, and only pairs have to be sorted. Whether a context is a
    state hangs on its suffix, not on its beginning; so contexts whose own suffix is no state are
    followed too, where a longer context may be one.
    """

    def __init__(self, row: dict, answers: list, n_train: int, n_distinct: int, buckets: int, ranks: list[int], depth: int = MAX_DEPTH):
        """``ranks``: the most keys with a rank in a bucket, of the words and of each level that is known."""
        self.answers, self.buckets, self.ranks, self.depth = answers, buckets, ranks, depth
        self.tokens = unpacked(row["tokens"]).astype(np.int32)
        self.sizes = np.array(row["sizes"], np.int64)
        self.train = np.repeat(np.array(row["train"], bool), self.sizes)
        self.ends = np.cumsum(self.sizes)
        self.place = (np.arange(len(self.tokens)) - np.repeat(self.ends - self.sizes, self.sizes)).astype(np.int32)
        counts = answered(answers[0], int(self.tokens.max(initial=-1)) + 1)[0][0].astype(np.int64)
        self.count = counts[self.tokens]
        self.base = (self.count + 1.0) / (n_train + n_distinct + 1.0)
        # Numbers of the words, and of the keys of the level before.
        self.ids = identities(answers[0], counts, 2, ranks[0])
        self.word, self.word_bits = self.ids[self.tokens], (buckets * ranks[0]).bit_length()
        self.prob = self.base.copy()
        # Of the keys of the level before: counts and a zero, and which one ends at each place (-1: none).
        self.totals, self.number = np.append(counts, 0), self.tokens
        self.active = np.ones(len(self.tokens), bool)

    def level(self, k: int, known_pairs: bool, known_contexts: bool) -> None:
        """Go one level deeper with what is known of it."""
        before = np.concatenate([np.full(1, -1, np.int32), self.number[:-1]])
        seen = self.totals[before]
        often_enough = (self.place >= k) & (seen >= MIN_CONTEXT)
        # Places whose context may be a state; and, of the others, those whose word may end the next
        # level's context: that needs the context without its first word to be frequent as well.
        judged = often_enough & self.active
        asked = np.zeros(0, np.int32)
        if k < self.depth and not self.active.all():
            passed = often_enough & ~self.active & (self.number >= 0)
            passed &= self.totals[self.number] >= MIN_CONTEXT
            if k == self.depth - 1:
                # The next level is the last, and judges a context only if its suffix was judged here.
                passed[:-1] &= judged[1:]
                passed[-1] = False
            asked = np.flatnonzero(passed).astype(np.int32)
        at = np.flatnonzero(judged).astype(np.int32)
        node, often = before[at], seen[at]
        used = np.zeros(len(self.ids), bool)
        used[node] = True
        contexts, context_of = self.ids[used], (np.cumsum(used) - 1)[node]
        # A word that followed the suffix once cannot follow the whole context twice.
        asking = self.totals[self.number[at]] >= 2
        asked = np.concatenate([at[asking], asked])
        span = self.buckets * self.ranks[k - 1]
        bits = self.word_bits + span.bit_length()
        if bits <= 64:
            pairs = scrambled((self.ids[before[asked]] << np.uint64(self.word_bits)) | self.word[asked], bits)
        else:
            bits, pairs = 64, mixed(mixed(self.ids[before[asked]]) ^ (self.word[asked] * np.uint64(0x9E3779B97F4A7C15)))
        pairs, first_at, pair_of = ranked(pairs, bits)
        if not known_pairs:
            trained = np.bincount(pair_of[self.train[asked]], minlength=len(pairs))
            self.wanted = pairs, [trained], 1 << bits
            return
        (totals, *_), first = answered(self.answers[2 * k - 1], len(pairs))
        totals = totals.astype(np.int64)
        if not known_contexts:
            # This block's share of each context's mass, followers and divergence: pairs it is first in.
            own = np.flatnonzero(first & (totals >= 2) & (first_at < asking.sum()))
            of = context_of[asking][first_at[own]]
            n, c = totals[own], often[asking][first_at[own]]
            gain = n * np.log(n / (c * self.prob[asked[first_at[own]]])) - 0.5 * np.log(c)
            size = len(contexts)
            sums = [np.bincount(of, n, minlength=size).astype(np.int64), np.bincount(of, minlength=size), np.bincount(of, gain, minlength=size)]
            counted = np.zeros(size, np.int64)
            counted[context_of] = often
            self.wanted = contexts, [*sums, counted], max(span, 1)
            return
        (is_state, *of_states), _ = answered(self.answers[2 * k], len(contexts))
        is_state = is_state.astype(bool)
        kept = is_state[context_of]
        states, c = at[kept], often[kept]
        state_of = (np.cumsum(is_state) - 1)[context_of[kept]]
        mass, followers = (x[state_of] for x in of_states[:2])
        self.number = np.full(len(self.tokens), -1, np.int32)
        self.number[asked] = pair_of
        follows = self.number[states]
        self.totals = np.append(totals, 0)
        n = self.totals[follows]
        left = 1.0 - (mass - DISCOUNT * followers) / c
        self.prob[states] = np.where(n >= 2, n - DISCOUNT, 0.0) / c + left * self.prob[states]
        self.active = np.zeros(len(self.tokens), bool)
        self.active[states] = True
        if k < self.depth:
            self.ids = identities(self.answers[2 * k - 1], totals, MIN_CONTEXT, self.ranks[k])

    def ask(self, step: int):
        k = (step + 1) // 2
        for level in range(1, k + 1):
            self.level(level, level < k or step % 2 == 0, level < k)
        return self.wanted

    def scores(self, depth: int):
        for level in range(1, depth + 1):
            self.level(level, True, True)
        starts = self.ends - self.sizes
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        return add((self.count > 0).astype(np.int64)), add(np.log10(self.base)), add(np.log10(self.prob))


# --- the whole ------------------------------------------------------------------------------


def _with_answers(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Blocks with all their answers, a column for each exchange. Both lie by block, so nothing moves."""
    for step, parts in enumerate(answers):
        rows = F.collect_list(F.struct("bucket", "columns", "first")).alias(f"answers_{step}")
        blocks = blocks.join(parts.groupBy("block").agg(rows).hint("shuffle_hash"), "block", "left")
    return blocks


def _walks(batch: pa.RecordBatch, *known):
    """Each block with its walk, one at a time."""
    for n in range(batch.num_rows):
        row = batch.slice(n, 1).to_pylist()[0]
        steps = sum(name.startswith("answers_") for name in row)
        yield row, Walk(row, [row.pop(f"answers_{i}") for i in range(steps)], *known)


def scored(docs: DataFrame, train, depth: int = MAX_DEPTH) -> DataFrame:
    """doc_id, trains, n_tokens, n_known, train_tokens, base_score, score of every row; the model learns
    from those where ``train`` is true."""
    blocks, parts = write_blocks(docs, train)
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(tokens / BUCKET_TOKENS))

    def ask_words(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                words = unpacked_keys(batch.column("words")[n].as_py())
                counts = unpacked(batch.column("counts")[n].as_py())
                yield _asked(requests(batch.column("block")[n].as_py(), words, [counts], buckets))

    answers = [exchanged(blocks.select("block", "words", "counts").mapInArrow(ask_words, ASKED), parts, 0)]
    found = answers[0].agg(F.sum("total").alias("n"), F.sum("positive").alias("v"), F.max("ranks").alias("ranks")).first()
    n_train, n_distinct = int(found["n"] or 0), int(found["v"] or 0)
    ranks = [found["ranks"] or 0]

    for step in range(1, 2 * depth + 1):

        def ask(batches, step=step):
            return_memory()
            for batch in batches:
                for row, walk in _walks(batch, n_train, n_distinct, buckets, ranks, depth):
                    keys, columns, span = walk.ask(step)
                    yield _asked(requests(row["block"], keys, columns, buckets, span))

        # Words are not read again: they have numbers now.
        answers.append(exchanged(_with_answers(blocks.drop("words", "counts"), answers).mapInArrow(ask, ASKED), parts, step))
        if step % 2 and step < 2 * depth - 1:
            ranks.append(answers[-1].agg(F.max("ranks")).first()[0] or 0)

    def score(batches):
        return_memory()
        for batch in batches:
            for row, walk in _walks(batch, n_train, n_distinct, buckets, ranks, depth):
                known, base, prob = walk.scores(depth)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["train"], pa.bool_()),
                        pa.array(row["sizes"], pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array([n_train] * len(known), pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(prob, pa.float64()),
                    ],
                    ["doc_id", "trains", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "doc_id long, trains boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _with_answers(blocks.drop("words", "counts"), answers).mapInArrow(score, schema)


def _asked(rows) -> pa.RecordBatch:
    kinds = [("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("columns", pa.list_(pa.binary()))]
    return pa.RecordBatch.from_pylist(list(rows), pa.schema(kinds))


def held_out_scores(docs: DataFrame, folds: int = 7, held: int = 2, depth: int = MAX_DEPTH) -> DataFrame:
    """``scored``, learning from the documents outside the held fold of doc_id."""
    return scored(docs, fold("doc_id", folds) != held, depth).withColumn("held_out", ~F.col("trains")).drop("trains")
