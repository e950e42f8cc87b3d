"""Exact nearest neighbours of a stated query set by a block matrix join.

Vectors are normalised and quantised to int8. Query blocks meet candidate blocks in tiles; the int8
product of a tile gives every cosine up to an error that is known per vector, so most pairs are
dismissed by their upper bound. Surviving pairs are computed again from the original floats, and
the k best of the tiles are merged by heaps.

Cases: vectors that are null, zero or hold null or non-finite components take no part (neither as
query nor as candidate), nor do rows without an id; vectors of another length than the query's are
no candidates for it; fewer than k candidates give fewer rows; ties go to the smaller id; a repeated
id is one candidate per row that differs; an empty table gives no rows.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rows of a block (4 MB of doubles at 64 dimensions), and the part of a tile computed at once.
BLOCK_ROWS = 8_192
STEP_QUERIES, STEP_CANDIDATES = 512, 4_096
# Products of int8 numbers stay exact in float32 sums up to this many dimensions.
EXACT_DIMS = (1 << 24) // (127 * 127)
# Rounding of the float32 and float64 steps around the exact integer product.
SLACK = 1e-9
PAIRS_AT_ONCE = 1 << 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a finite, non-zero vector, as double precision."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
        .withColumn("dims", F.size("v"))
    )


def _fewest_copies(candidates: DataFrame, keep: int) -> DataFrame:
    """Of equal vectors only the ``keep`` smallest ids can be among any query's nearest: a query
    excludes at most itself. Limits per group are applied before rows move, so a vector with a
    third of all rows does not meet in one task."""
    by_vector = W.partitionBy("v").orderBy("id")
    return candidates.distinct().withColumn("copy", F.row_number().over(by_vector)).where(F.col("copy") <= keep).drop("copy")


def _blocks(rows: DataFrame, count: int, name: str) -> DataFrame:
    """(dims, <name> block number, ids, floats): about ``BLOCK_ROWS`` rows each, dealt by hash of the id."""
    blocks = max(1, math.ceil(count / BLOCK_ROWS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    return dealt.groupBy("dims", "block").applyInArrow(_pack, "dims int, block long, ids binary, floats binary").withColumnRenamed("block", name)


def _pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    order = np.argsort(rows["id"].to_numpy(), kind="stable")
    ids = rows["id"].to_numpy()[order].astype(np.int64)
    floats = rows["v"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
    return pa.table(
        {
            "dims": pa.array([key[0].as_py()], pa.int32()),
            "block": pa.array([key[1].as_py()], pa.int64()),
            "ids": pa.array([ids.tobytes()], pa.binary()),
            "floats": pa.array([np.ascontiguousarray(floats, np.float64).tobytes()], pa.binary()),
        }
    )


def quantise(floats: np.ndarray):
    """Unit vectors as int8 codes (held in float32), scale, norm of the code and norm of the error."""
    unit = floats / np.abs(floats).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None])
    near = codes * scale[:, None]
    error = np.sqrt(((unit - near) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale, np.sqrt((near * near).sum(axis=1)), error


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of two int8 blocks: sums stay below 2**24, where float32 is exact."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_DIMS):
        part = slice(at, at + EXACT_DIMS)
        total += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return total


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products summed in the order of dimensions, so equal rows give equal bits."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        found = _dots(a, b) / (np.sqrt(_dots(a, a)) * np.sqrt(_dots(b, b)))
        odd = ~np.isfinite(found)  # squares beyond the range of doubles: scale the rows first
        if odd.any():
            x, y = (m[odd] / np.abs(m[odd]).max(axis=1, keepdims=True) for m in (a, b))
            found[odd] = _dots(x, y) / (np.sqrt(_dots(x, x)) * np.sqrt(_dots(y, y)))
    return found


def _tile(q_ids, q, c_ids, c, k, heaps):
    """Put the k best candidates of this tile into the heap of each query."""
    q_codes, q_scale, _, q_error = quantise(q)
    c_codes, c_scale, c_norm, c_error = quantise(c)
    for i in range(0, len(q_ids), STEP_QUERIES):
        qs = slice(i, i + STEP_QUERIES)
        for j in range(0, len(c_ids), STEP_CANDIDATES):
            cs = slice(j, j + STEP_CANDIDATES)
            near = _products(q_codes[qs], c_codes[cs]) * q_scale[qs, None] * c_scale[None, cs]
            # <q,c> = <q',c'> + <q-q',c'> + <q,c-c'>, and q has norm 1
            bound = q_error[qs, None] * c_norm[None, cs] + c_error[None, cs] + SLACK
            low, high = near - bound, near + bound
            itself = q_ids[qs, None] == c_ids[None, cs]
            low[itself] = high[itself] = -np.inf
            floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
            full = np.array([heaps[x][0][0] if len(heaps.get(x, ())) == k else -np.inf for x in q_ids[qs].tolist()])
            rows, cols = np.nonzero((high >= np.maximum(floor, full - SLACK)[:, None]) & (high > -np.inf))
            for at in range(0, len(rows), PAIRS_AT_ONCE):
                r, s = rows[at : at + PAIRS_AT_ONCE] + i, cols[at : at + PAIRS_AT_ONCE] + j
                scores = cosines(q[r], c[s])
                for query, candidate, score in zip(q_ids[r].tolist(), c_ids[s].tolist(), scores.tolist()):
                    _push(heaps.setdefault(query, []), (score, -candidate), k)


def _push(heap: list, item: tuple, k: int) -> None:
    if len(heap) < k:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def _heap_columns(heaps: dict) -> dict:
    found = [(query, -ident, score, n + 1) for query, heap in heaps.items() for n, (score, ident) in enumerate(sorted(heap, reverse=True))]
    query, ident, score, rank = zip(*found) if found else ((), (), (), ())
    return {
        "query_id": pa.array(query, pa.int64()),
        "rank": pa.array(rank, pa.int32()),
        "id": pa.array(ident, pa.int64()),
        "score": pa.array(score, pa.float64()),
    }


def nearest(vectors: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, id, score: the k candidates of largest cosine for each row of ``queries`` (a part
    of ``vectors`` or another table with the same two columns), itself excluded by its id."""
    candidates = _fewest_copies(usable(vectors, id_col, vector_col), k + 1)
    asked = usable(queries, id_col, vector_col).distinct()
    n_asked = asked.count()
    rows = usable(vectors, id_col, vector_col).count()
    left, right = _blocks(asked, n_asked, "q"), _blocks(candidates, rows, "c")
    # One row per tile: a candidate block goes to each query block of its dimension.
    left_blocks = max(1, math.ceil(n_asked / BLOCK_ROWS))
    spread = right.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(left_blocks - 1).cast("long"))))
    asked_side = left.select("dims", "q", F.col("ids").alias("q_ids"), F.col("floats").alias("q_floats"))
    tasks = _tile_tasks(vectors, left_blocks, rows)
    stripe = F.pmod(F.col("c"), F.lit(math.ceil(tasks / left_blocks)))
    tiles = spread.join(asked_side, ["dims", "q"]).repartition(tasks, F.col("q"), stripe)

    schema = "query_id long, rank int, id long, score double"

    def best_of_task(batches):
        heaps: dict = {}
        for batch in batches:
            for n in range(batch.num_rows):
                q_ids, c_ids = (np.frombuffer(batch.column(x)[n].as_buffer(), np.int64) for x in ("q_ids", "ids"))
                q, c = (np.frombuffer(batch.column(x)[n].as_buffer(), np.float64) for x in ("q_floats", "floats"))
                _tile(q_ids, q.reshape(len(q_ids), -1), c_ids, c.reshape(len(c_ids), -1), k, heaps)
        yield pa.RecordBatch.from_pydict(_heap_columns(heaps))

    partial = tiles.select("q_ids", "q_floats", "ids", "floats").mapInArrow(best_of_task, schema)

    def merge(rows: pa.Table) -> pa.Table:
        return _merge(rows, k)

    return partial.groupBy("query_id").applyInArrow(merge, schema)


def _tile_tasks(df: DataFrame, left_blocks: int, rows: int) -> int:
    """A task per tile, within reason: tiles are alike in cost."""
    tiles = left_blocks * max(1, math.ceil(rows / BLOCK_ROWS))
    return int(min(tiles, 20 * max(df.sparkSession.sparkContext.defaultParallelism, math.isqrt(tiles))))


def _merge(rows: pa.Table, k: int) -> pa.Table:
    """The k best of one query's tiles: k rows from each tile task."""
    heap: list = []
    for ident, score in zip(rows["id"].to_pylist(), rows["score"].to_pylist()):
        if (score, -ident) not in heap:
            _push(heap, (score, -ident), k)
    return pa.table(_heap_columns({rows["query_id"][0].as_py(): heap}))
