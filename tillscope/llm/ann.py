"""Approximate nearest neighbours with a hash-prefix forest.

A tree is a sorted array of long hash strings: bit ``k`` of a vector's string
says on which side of the tree's ``k``-th random hyperplane it lies.  The rows
that agree with a query in their first ``x`` bits are one run of the array, so
descending a tree is a binary search for longer and longer prefixes.  A query
starts at the longest prefixes and ascends all trees together, one bit a step,
until the runs hold enough candidates; those are compared by exact cosine.

A vector that many rows share is indexed once, with its smallest ids beside it,
so copies neither fill a query's candidates nor gather in one shard.  Vectors
are dealt to shards, each with its own forest; the stated queries meet
the shards in blocks, and each pair of block and shard returns its nearest
rows for each query only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.common import pick, stored

SEED = 77
#: Trees of a forest and bits of a hash string.
TREES = 96
BITS = 32
#: A query's candidates in a shard, each counted once, as a share of its distinct vectors, and at least.
CANDIDATE_SHARE = 0.3
LEAST_CANDIDATES = 2_000
#: Distinct vectors of a shard and queries of a block.
SHARD_ROWS = 16_384
BLOCK_QUERIES = 4_096
#: Queries searched at a time, which bounds a task's matrices.
STEP_QUERIES = 256


class Forest:
    """Sorted hash strings of one shard's vectors, for each tree."""

    def __init__(self, unit: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        planes = np.random.default_rng([seed, unit.shape[1]]).standard_normal((unit.shape[1], trees * bits))
        self.planes, self.trees, self.bits, self.unit = planes, trees, bits, unit
        strings = self.strings(unit)
        self.order = [np.argsort(strings[:, t], kind="stable") for t in range(trees)]
        self.sorted = [strings[self.order[t], t] for t in range(trees)]

    def strings(self, unit: np.ndarray) -> np.ndarray:
        """Hash strings as integers, the first bit highest; a column for each tree."""
        out = np.empty((len(unit), self.trees), np.uint64)
        weights = (np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64))
        for at in range(0, len(unit), 2048):
            side = (unit[at:at + 2048] @ self.planes > 0).reshape(-1, self.trees, self.bits)
            out[at:at + 2048] = (side * weights).sum(axis=2, dtype=np.uint64)
        return out

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """Rows found for each query (a mask over the shard), ascending all trees together."""
        strings, n = self.strings(queries), len(self.unit)
        low = np.zeros((self.bits + 1, len(queries), self.trees), np.int32)
        high = np.full((self.bits + 1, len(queries), self.trees), n, np.int32)
        for t in range(self.trees):
            for x in range(1, self.bits + 1):  # descend by one bit
                rest = np.uint64(self.bits - x)
                first = (strings[:, t] >> rest) << rest
                low[x, :, t] = np.searchsorted(self.sorted[t], first)
                high[x, :, t] = np.searchsorted(self.sorted[t], first | ((np.uint64(1) << rest) - np.uint64(1)), "right")
        found = (high - low).sum(axis=2, dtype=np.int64)
        for q in range(len(queries)):
            depth = max((x for x in range(self.bits + 1) if found[x, q] >= wanted), default=0)
            while True:  # ascend; a row found by several trees counts once
                mask = np.zeros(n, bool)
                for t in range(self.trees):
                    mask[self.order[t][low[depth, q, t]:high[depth, q, t]]] = True
                if not depth or np.count_nonzero(mask) >= wanted:
                    break
                depth -= 1
            yield mask


def usable(vector: str) -> Column:
    """True for vectors that take part: not null, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of the vector with each row, in double precision; a row's value does not depend on other rows."""
    dot = np.einsum("ij,j->i", rows, query)
    return dot / (np.sqrt(np.einsum("ij,ij->i", rows, rows)) * np.sqrt(np.einsum("j,j->", query, query)))


def shortlist(rough: np.ndarray, ids: list[np.ndarray], least: int) -> np.ndarray:
    """Positions of the best rough scores that hold ``least`` distinct ids, or of all; what ties with the last is in."""
    order, upto = np.argsort(-rough, kind="stable"), least
    while upto < len(order) and len(np.unique(np.concatenate([ids[i] for i in order[:upto]]))) < least:
        upto *= 2
    return order if upto >= len(order) else np.flatnonzero(rough >= rough[order[upto - 1]] - 1e-9)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding", trees: int = TREES, share: float = CANDIDATE_SHARE) -> DataFrame:
    """The ``k`` nearest rows found for each query: ``query_id, rank, vec_id, score``.

    ``score`` is the exact cosine of the original vectors in double precision;
    ties go to the smaller id.  A row is not its own neighbour, nor is any row
    with the query's id.

    * vectors that are null, zero or hold null or non-finite components take
      no part, nor do rows with a null id; neither do vectors whose length
      differs from the query's (they are never compared);
    * rows that repeat an id are found once, by their best score;
    * a query with fewer candidates gets them all; an empty table gives an
      empty result; other columns are ignored.
    """
    def clean(df: DataFrame) -> DataFrame:
        own = pick(df, vec_id=id_col, v=vector_col).select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
        return own.where(usable("v") & F.col("vec_id").isNotNull()).groupBy("vec_id", "v").agg(F.size("v").alias("dims"))

    # of equal vectors the k + 1 smallest ids are enough: one may be the query's own, and ties go to the smaller
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    rows = stored(clean(vectors).withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v", "dims").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    asked = stored(clean(queries), "asked-vectors")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    spot = lambda n, *key: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    dealt = rows.withColumn("shard", spot(shards, "v", F.lit(1))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    posed = asked.withColumn("block", spot(blocks, "vec_id", "v", F.lit(2))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(key: tuple, own: pd.DataFrame, posed: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        if len(own) and len(posed):
            ids, matrix = own["ids"].to_list(), np.stack(own["v"].to_numpy())
            # scaled by the largest component first, so that no square overflows or vanishes
            unit = matrix / np.abs(matrix).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            forest = Forest(unit, trees)
            wanted = max(LEAST_CANDIDATES, int(share * len(own)))
            for at in range(0, len(posed), STEP_QUERIES):
                part = posed.iloc[at:at + STEP_QUERIES]
                asking = np.stack(part["v"].to_numpy())
                scaled = asking / np.abs(asking).max(axis=1, keepdims=True)
                for query_id, vector, mask in zip(part["vec_id"].to_numpy(), scaled, forest.candidates(scaled, wanted)):
                    hit = np.flatnonzero(mask)
                    # a plain product orders them; the best few, one id more for the query's own, are scored exactly
                    rough = unit[hit] @ (vector / np.linalg.norm(vector))
                    hit = hit[shortlist(rough, [ids[i] for i in hit], 2 * k + 1)]
                    score = cosine(vector, matrix[hit] / np.abs(matrix[hit]).max(axis=1, keepdims=True))
                    held = [ids[i] for i in hit]
                    best = pd.DataFrame({"query_id": query_id, "vec_id": np.concatenate(held),
                                         "score": np.repeat(score, [len(x) for x in held])})
                    best = best[best["vec_id"] != query_id]
                    best = best.sort_values(["score", "vec_id"], ascending=[False, True]).drop_duplicates("vec_id")
                    out.append(best.head(k))
        return pd.concat(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = dealt.groupBy("shard", "block", "dims").cogroup(posed.groupBy("shard", "block", "dims")).applyInPandas(
        search, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
