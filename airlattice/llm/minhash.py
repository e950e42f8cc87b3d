"""Near copies by bottom-k sketches.

A text is the set of its word shingles; one hash function orders all shingles, and the ``k`` least
are a text's sketch. Texts of equal sets are one class, so copies of any number are one entry. Two
sets alike enough share many sketch values, so each class is entered only under its rarest values,
just as many as make a shared one certain (see ``needed``). Classes of one inverted list are
candidates; the union of two sketches is itself a sketch and estimates the similarity; what passes
is confirmed on the full sets.

A list is not unfolded into all its pairs while that would be many: its classes are compared with one
of them, its hub, what that links is one component, and only pairs of different components are left.
Those are compared in blocks of bounded size, all classes that share a hub with each other; sets
travel to their blocks, not to each of their pairs. None of this leaves out a link.

What may be lost: sets within the ``k`` least are compared exactly, and of larger ones a pair at the
threshold shares fewer than ``needed`` sketch values with a chance of 1e-9 (more alike, less).

Cases: a null or empty text, or one without words, has no shingles, is linked with nothing and is its
own component; fewer words than a shingle are one shingle; repeated rows and ids give a row each; a
row without an id takes part and gets the component's smallest id, null if the component has none
(such rows are all kept); an empty table gives no rows; extra columns are not looked at.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.joins import MAX_BROADCAST_KEYS, broadcast_if_small
from airlattice.llm.common import arrow_rows, byte_texts, return_memory, stage
from airlattice.llm.components import components
from airlattice.llm.hot_keys import join_hot

SHINGLE = 4
SIMILARITY = (80, 100)
K = 64
LOSS = 1e-9
# Words whose hash a worker keeps; shingles of a text mixed at once.
KEPT_WORDS = 300_000
# Shingles of the sets in one block, and classes that the others of a block are placed by.
BLOCK_SHINGLES = 300_000
PIVOTS = 8
# Pairs that an entry of an open list may stand for without a round of stars, and the most rounds.
PAIRS_PER_POSTING = 4
MAX_STARS = 5
# Pairs whose sketches are compared at once.
STEP = 4096

_FACTORS = [xxhash.xxh64_intdigest(b"place", seed) | 1 for seed in range(64)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: bytes, hashes: dict, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: word hashes times a factor per place, mixed."""
    words = text.lower().split()
    found = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not words:
        return found.view(np.int64)
    size = min(shingle, len(words))
    places = len(words) - size + 1
    # fewer words than a shingle must not look like the beginning of one
    mixed = np.full(places, size, np.uint64)
    for i in range(size):
        mixed += found[i : i + places] * np.uint64(_FACTORS[i])
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(_FACTORS[-1])
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(_FACTORS[-2])
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def _row_hash() -> Column:
    """Finds a row again by its id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def sketches(docs: DataFrame, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """doc_id, row_hash, n (distinct shingles), set_id (digest of the set), sketch (the k least hashes)."""

    def make():
        return_memory()
        hashes = _WordHashes()

        def step(batch):
            sizes, digests, ends, values = [], [], [0], []
            for text in byte_texts(batch.column("text")):
                found = shingle_set(text, hashes, shingle)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                values.append(found[:k].copy())
                ends.append(ends[-1] + len(values[-1]))
            flat = np.concatenate(values) if values else np.empty(0, np.int64)
            return {
                "doc_id": batch.column("doc_id"), "row_hash": batch.column("row_hash"), "n": pa.array(sizes, pa.int64()),
                "set_id": pa.array(digests, pa.binary()),
                "sketch": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
            }

        return step

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row_hash().alias("row_hash"))
    return arrow_rows(columns, "doc_id long, row_hash long, n long, set_id binary, sketch array<bigint>", make)


def distinct_sets(marked: DataFrame) -> DataFrame:
    """A row per set that is not empty: cls (a number), set_id, n, sketch, least (smallest id), row_hash (of a row
    that holds it). Copies are brought together per task before they are moved."""
    sets = marked.where("n > 0").groupBy("set_id").agg(
        F.max("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"), F.min("row_hash").alias("row_hash")
    )
    return sets.withColumn("cls", F.monotonically_increasing_id())


# --- candidates -----------------------------------------------------------------------------


def certain_overlap(k: int = K, similarity=SIMILARITY, loss: float = LOSS) -> int:
    """The number of values that two sets of just this similarity share among the k least of their
    union, but for a chance of ``loss``."""
    p, chance = similarity[0] / similarity[1], 0.0
    for shared in range(k + 1):
        chance += math.comb(k, shared) * p**shared * (1 - p) ** (k - shared)
        if chance > loss:
            return shared
    return k


def needed(n: Column, k: int = K, similarity=SIMILARITY) -> Column:
    """Sketch values that a set of ``n`` shares at least with any other that is similar enough. Sets that
    only have partners within ``k`` shingles share their part of all shingles; others share what
    is certain of a sketch."""
    part, whole = similarity
    share = F.ceil(F.least(n, F.lit(k)) * part / F.lit(float(whole)))
    return F.when(n * whole <= k * part, share).otherwise(F.least(share, F.lit(certain_overlap(k, similarity)))).cast("int")


def postings(sets: DataFrame, k: int = K, similarity=SIMILARITY) -> DataFrame:
    """value, cls, n: each set under the rarest values of its sketch. If two sets share m of their values,
    then the first (size - m + 1) of both, in any order common to all sets, share one."""
    values = sets.select("cls", "n", F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    counts = stage(counts, "values")
    shared = join_hot(values, counts, "value")
    # A set has at most k of them. Values of no other set come first in the order and list nothing.
    own = shared.groupBy("cls").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("held", "value"))).alias("held"))
    size = F.least("n", F.lit(k)).cast("int")
    places = size - needed(F.col("n"), k, similarity) + 1 - (size - F.size("held"))
    listed = own.where(places > 0).select("cls", "n", F.explode(F.slice("held", F.lit(1), places)).alias("entry"))
    return listed.select(F.col("entry.value").alias("value"), "cls", "n")


def hub_groups(lists: DataFrame, turn: int) -> DataFrame:
    """hub, root_hub, cls, n, root: one class of each list, the first by a hash, with all classes of its lists
    (itself too), once each. Lists that name one text's passages mostly choose the same hub."""
    first = lists.groupBy("value").agg(F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), "cls", "root")).alias("hub"))
    hubs = stage(first.select("value", F.col("hub.cls").alias("hub"), F.col("hub.root").alias("root_hub")), "hubs")
    return join_hot(lists, hubs, "value").select("hub", "root_hub", "cls", "n", "root").distinct()


# --- confirmation ---------------------------------------------------------------------------


def _matrix(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Sketches as rows of ``k`` numbers, for places beyond a small set's end the largest."""
    found = np.full((len(sets), k), np.iinfo(np.int64).max)
    for row, one in zip(found, sets):
        row[: min(k, len(one))] = one[:k]
    return found


def ruled_out(one: np.ndarray, other: np.ndarray, certain: int, similarity=SIMILARITY) -> np.ndarray:
    """Which rows of two sketch matrices cannot be similar enough. The k least values of both together are
    the sketch of the union; those that both hold are its part of the intersection."""
    k, filler = one.shape[1], np.iinfo(np.int64).max
    both = np.sort(np.concatenate([one, other], axis=1), axis=1)
    fresh = np.ones(both.shape, bool)
    fresh[:, 1:] = both[:, 1:] != both[:, :-1]
    real = both != filler
    place = np.cumsum(fresh & real, axis=1)
    shared = (~fresh & real & (place <= k)).sum(axis=1)
    alike = -(-np.minimum(k, place[:, -1]) * similarity[0] // similarity[1])
    return shared < np.minimum(alike, certain)


def _shared(one: np.ndarray, other: np.ndarray) -> int:
    few, many = (one, other) if len(one) <= len(other) else (other, one)
    at = np.searchsorted(many, few)
    return int((many[np.minimum(at, len(many) - 1)] == few).sum())


def _distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """The share of the union that a set and a pivot do not share."""
    found = np.empty((len(sets), len(pivots)))
    for i, one in enumerate(sets):
        for j, other in enumerate(pivots):
            shared = _shared(one, other)
            found[i, j] = 1 - shared / (len(one) + len(other) - shared)
    return found


def linked_pairs(left: list, right: list, roots_left, roots_right, same: bool, k: int = K, similarity=SIMILARITY) -> list[tuple[int, int]]:
    """Positions of pairs of two lists of sets (or of one, if they are the ``same``) that are in different
    components and similar enough: as many as tie together all that is linked. Pairs that the links
    before them join already are not looked at, so there are fewer links than sets.

    Ruled out before any whole sets are compared: by their sizes; by their distances from some pivots,
    which obey the triangle inequality, so that those of linked sets differ little; by their sketches.
    """
    part, whole = similarity
    sizes_left, sizes_right = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    open_pairs = roots_left[:, None] != roots_right[None, :]
    open_pairs &= (sizes_left[:, None] * whole >= sizes_right * part) & (sizes_right * whole >= sizes_left[:, None] * part)
    if same:
        open_pairs &= np.arange(len(left))[:, None] < np.arange(len(right))
    if open_pairs.sum() > PIVOTS * (len(left) + len(right)):
        pivots = left[:: max(1, len(left) // PIVOTS)][:PIVOTS]
        for x, y in zip(_distances(left, pivots).T, _distances(right, pivots).T):
            open_pairs &= np.abs(x[:, None] - y) <= (whole - part) / whole + 1e-9
    rows, columns = np.nonzero(open_pairs)
    sketch_left, sketch_right, certain, found = _matrix(left, k), _matrix(right, k), certain_overlap(k, similarity), []
    tied: dict = {}

    def root(x: int) -> int:
        while (up := tied.get(x, x)) != x:
            tied[x] = x = tied.get(up, up)
        return x

    roots_left, roots_right = roots_left.tolist(), roots_right.tolist()
    for at in range(0, len(rows), STEP):
        x, y = rows[at : at + STEP], columns[at : at + STEP]
        kept = ~ruled_out(sketch_left[x], sketch_right[y], certain, similarity)
        for i, j in zip(x[kept].tolist(), y[kept].tolist()):
            one, other = root(roots_left[i]), root(roots_right[j])
            if one == other:
                continue
            shared = _shared(left[i], right[j])
            if whole * shared >= part * (len(left[i]) + len(right[j]) - shared):
                found.append((i, j))
                tied[one] = other
    return found


def _linked_in_groups(dealt: DataFrame, keys: list[str], k: int, similarity) -> DataFrame:
    """a, b: linked pairs of the two sides (0 and 1) of every group; a group of side 0 alone is compared with
    itself."""

    def compare(table):
        return_memory()
        side = table.column("side").to_numpy()
        sets = [np.frombuffer(c.as_buffer(), np.int64) for c in table.column("hashes")]
        cls, roots = table.column("cls").to_numpy(), table.column("root").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(right)
        right = left if same else right
        found = linked_pairs([sets[i] for i in left], [sets[i] for i in right], roots[left], roots[right], same, k, similarity)
        a = cls[left[[i for i, _ in found]]] if found else np.empty(0, np.int64)
        b = cls[right[[j for _, j in found]]] if found else np.empty(0, np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy(*keys).applyInArrow(compare, "a long, b long")


def _in_blocks(groups: DataFrame) -> DataFrame:
    """``groups`` with blocks, how many blocks a hub's classes make, and block."""
    blocks = groups.groupBy("hub").agg(F.ceil(F.sum("n") / F.lit(float(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    dealt = join_hot(groups, stage(blocks, "blocks"), "hub")
    return dealt.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))


def star_links(groups: DataFrame, full: DataFrame, k: int = K, similarity=SIMILARITY) -> DataFrame:
    """a, b: the links of hubs with the classes of their lists that are in other components."""
    dealt = _in_blocks(groups)
    members = dealt.where("root <> root_hub").select("hub", "block", F.lit(1).alias("side"), "cls", "root")
    centres = members.select("hub", "block").distinct().join(dealt.where("cls = hub").select("hub", "root"), "hub")
    both = stage(members.unionByName(centres.select("hub", "block", F.lit(0).alias("side"), F.col("hub").alias("cls"), "root")), "stars")
    return _linked_in_groups(join_hot(both, full, "cls", share=1e-2), ["hub", "block"], k, similarity)


def block_links(groups: DataFrame, full: DataFrame, k: int = K, similarity=SIMILARITY) -> DataFrame:
    """a, b: the links between classes with the same hub that are in different components. Every two blocks
    of a hub's classes meet in a group of their own."""
    dealt = stage(_in_blocks(groups), "blocks")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = join_hot(dealt, full, "cls", share=1e-2).select("hub", "block", "cls", "root", "hashes", every)
    dealt = pairs.select(
        "hub", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "cls", "root", "hashes",
    )
    return _linked_in_groups(dealt, ["hub", "x", "y"], k, similarity)


def full_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """cls, hashes: the whole sets of the classes ``wanted`` (cls), made again from a text of each."""
    rows = stage(sets.join(wanted, "cls", "left_semi").select("row_hash", "cls", "set_id"), "wanted")
    texts = docs.select(F.col("text").cast("string").alias("text"), _row_hash().alias("row_hash"))
    chosen = texts.join(broadcast_if_small(rows, MAX_BROADCAST_KEYS), "row_hash").select("cls", "set_id", "text")

    def make():
        return_memory()
        hashes = _WordHashes()

        def step(batch):
            found = [shingle_set(text, hashes, shingle).tobytes() for text in byte_texts(batch.column("text"))]
            same = [xxhash.xxh3_128_digest(f) == d for f, d in zip(found, batch.column("set_id").to_pylist())]
            kept = pa.array(same, pa.bool_())
            return {"cls": batch.column("cls").filter(kept), "hashes": pa.array(found, pa.binary()).filter(kept)}

        return step

    # repeated rows give a set again
    return arrow_rows(chosen, "cls long, hashes binary", make).groupBy("cls").agg(F.first("hashes").alias("hashes"))


# --- components -----------------------------------------------------------------------------


def _open_lists(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    """value, cls, n, root of the lists that hold more than one component."""
    if roots is None:
        rooted = lists.withColumn("root", F.col("cls"))
    else:
        joined = lists.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        rooted = stage(joined.select("value", "cls", "n", F.coalesce("root", "cls").alias("root")), "lists")
    bounds = rooted.groupBy("value").agg((F.min("root") < F.max("root")).alias("open")).where("open").select("value")
    return stage(join_hot(rooted, stage(bounds, "open"), "value"), "lists")


def _pairs_left(lists: DataFrame) -> tuple[int, float]:
    """Entries, and the pairs that they stand for at most."""
    row = lists.groupBy("value").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1.0) / 2)).first()
    return row[0] or 0, row[1] or 0.0


def links(docs: DataFrame, sets: DataFrame, shingle: int = SHINGLE, k: int = K, similarity=SIMILARITY) -> DataFrame | None:
    """node, root: the component of every class that is linked with another, None without any link.

    Stars first, as long as the lists that are open stand for many pairs and a round leaves at most
    half of them; then all pairs of different components that are left.
    """
    lists = _open_lists(stage(postings(sets, k, similarity), "postings"), None)
    full = stage(full_sets(docs, sets, lists.select("cls").distinct(), shingle), "sets")
    roots, found, before = None, None, math.inf
    for turn in range(MAX_STARS + 1):
        if turn:
            lists = _open_lists(lists.select("value", "cls", "n"), roots)
        entries, left = _pairs_left(lists)
        if not entries:
            break
        last = turn == MAX_STARS or left <= PAIRS_PER_POSTING * entries or left > before / 2
        before = left
        groups = stage(hub_groups(lists, turn), "groups")
        fresh = stage((block_links if last else star_links)(groups, full, k, similarity), "links")
        found = fresh if found is None else found.unionByName(fresh)
        roots = components(found)
        if last:
            break
    return roots


def near_copies(docs: DataFrame, shingle: int = SHINGLE, k: int = K, similarity=SIMILARITY) -> DataFrame:
    """doc_id, n (distinct shingles), component_id, kept (the document its component is named after)."""
    marked = stage(sketches(docs, shingle, k), "sketches")
    sets = stage(distinct_sets(marked), "sets")
    roots = links(docs, sets, shingle, k, similarity)
    named = sets.select("cls", "set_id", "least", F.col("cls").alias("root"))
    if roots is not None:
        named = sets.select("cls", "set_id", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        named = named.withColumn("root", F.coalesce("root", "cls"))
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = named.join(least, "root")
    else:
        named = named.withColumn("component_id", F.col("least"))
    named = stage(named.select("set_id", "component_id"), "components")
    some = join_hot(marked.where("n > 0").select("doc_id", "n", "set_id"), named, "set_id")
    none = marked.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    rows = some.select("doc_id", "n", "component_id").unionByName(none)
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
