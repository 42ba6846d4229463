"""Exact top-k search by inner product of integer vectors with MaxScore.

A term is a dimension. For a query weight q the posting list of a term holds the candidates whose component has the sign
of q, so that every posting adds to the score and every other candidate gets at most 0 from the term. The bound of a
term is |q| times its largest component of that sign. Terms are sorted by bound; those whose bounds together stay below
the current k-th score are non-essential: a candidate that stands in no essential list cannot enter the result. The
essential postings are traversed, and their candidates are probed in the remaining terms while they stay competitive.
Candidates lie in shards, of which each is one task; one shuffle brings each candidate to its shard and all queries to
every shard, without the driver, and the best k of the shards are merged. A shard is worked through in pieces: the k-th
score so far is the floor of the next piece.

Results for odd rows: vectors that are null or hold null or non-finite components take no part, nor do rows without
id; components past the shorter of two vectors count as 0; each of several equal rows is a candidate of its own (of which
k at most can enter a result, so no more travel), while equal query rows are one query; a query has no candidate with its
own id; ties go to the smaller id; a query without candidates gives no row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.common import saved, small_batches

#: Components of the candidates of a shard, at most on average.
SHARD_NUMBERS = 1 << 21
#: Candidates of a shard on average, more where there would be over ``SHARDS`` shards and over one per core: each shard
#: gets all queries.
SHARD_ROWS = 8_192
SHARDS = 64
#: Candidates of a shard that are scored before the floor rises.
PIECE = 4_096


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """Rows (id, vec array<long>) of floor(scale * x), usable vectors only."""
    x = F.col(vector_column)
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return (rows.where(F.col(id_column).isNotNull() & x.isNotNull()).where(fine)
            .select(F.col(id_column).cast("long").alias("id"),
                    F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("vec")))


def top_k(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` best candidates of each query.

    ``rows`` has (id, vec); ``is_query`` marks the query set, which is searched against all rows.
    """
    rows = saved(rows.groupBy("id", "vec").agg(F.least(F.count("*"), F.lit(k)).alias("copies")), "vectors")
    sizes = rows.agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.size("vec")).alias("numbers")).first()
    at_once = max(SHARDS, rows.sparkSession.sparkContext.defaultParallelism)
    shards = max(min(-(-(sizes["n"] or 0) // SHARD_ROWS), at_once), -(-(sizes["numbers"] or 0) // SHARD_NUMBERS), 1)
    place = F.pmod(F.xxhash64("id", "vec", "copy"), F.lit(shards)).cast("int")
    candidates = (rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
                  .select(place.alias("shard"), F.lit(False).alias("asks"), "id", "vec"))
    queries = (rows.where(is_query)
               .select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "vec"))
    # not a join: its estimate leaves out that queries are repeated for each shard, so all of that could be broadcast
    both = candidates.unionAll(queries).repartitionById(shards, "shard").sortWithinPartitions("asks").select("asks", "id", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, shard = [], None
        for batch in batches:  # one shard's candidates, then the queries
            many = batch.column(0).false_count
            if many:
                parts.append(_matrix(batch.slice(0, many)))
            if many == batch.num_rows:
                continue
            if shard is None:
                shard, parts = Shard(*_stacked(parts)), []
            out = [[], [], []]
            for query, vector in zip(*_matrix(batch.slice(many)), strict=True):
                found, scores = shard.search(int(query), vector, k)
                for column, values in zip(out, ([query] * len(found), found, scores), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    found = small_batches(both).mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _matrix(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of rows (.., id, vec); shorter vectors end in zeros."""
    ids, lists = rows.column("id").to_numpy().copy(), rows.column("vec")  # a view would keep the batch
    flat, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(ids), int(lengths.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(ids)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return ids, out


def _stacked(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of all parts; shorter vectors end in zeros."""
    out = np.zeros((sum(len(ids) for ids, _ in parts), max((v.shape[1] for _, v in parts), default=0)), np.int64)
    start = 0
    for ids, vectors in parts:
        out[start:start + len(ids), :vectors.shape[1]] = vectors
        start += len(ids)
    return np.concatenate([np.zeros(0, np.int64), *(ids for ids, _ in parts)]), out


class Shard:
    """Postings by dimension and sign, and the MaxScore search over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(vectors[order].T)
        self.highest = np.maximum(self.columns.max(axis=1, initial=0), 0)
        self.lowest = np.minimum(self.columns.min(axis=1, initial=0), 0)
        self.postings = [(np.flatnonzero(c > 0), np.flatnonzero(c < 0)) for c in self.columns]

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        """Ids and scores of the best ``k``, best first; ties to the smaller id."""
        wide = len(self.columns)
        query = np.pad(query[:wide], (0, max(0, wide - len(query))))
        bounds = np.where(query > 0, query * self.highest, query * self.lowest)
        terms = np.argsort(-bounds, kind="stable")
        terms = terms[query[terms] != 0]
        rest = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0)  # bound of the terms from a place on
        other = self.ids != query_id
        if not other.any():
            return [], []
        floor = self._first_floor(query, terms, other, k)
        # place of the weightiest term that a candidate has a posting of; past all terms without any
        first = np.full(len(self.ids), len(terms))
        for place in range(self._essential(rest, floor) - 1, -1, -1):
            t = terms[place]
            first[self.postings[t][0 if query[t] > 0 else 1]] = place
        cand = np.flatnonzero(other)
        best_at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for start in range(0, len(cand), PIECE):
            piece = cand[start:start + PIECE]
            if floor is not None and floor > 0:  # else a candidate without any posting could still belong to the result
                piece = piece[first[piece] < self._essential(rest, floor)]
            score = np.zeros(len(piece), np.int64)
            for place, t in enumerate(terms):
                score += query[t] * self.columns[t][piece]
                if floor is not None and place % 4 == 3:
                    keep = score + rest[place + 1] >= floor
                    if not keep.all():
                        piece, score = piece[keep], score[keep]
            best_at, best = np.append(best_at, piece), np.append(best, score)
            if len(best) > k:
                order = np.lexsort((self.ids[best_at], -best))[:k]
                best_at, best = best_at[order], best[order]
            if len(best) == k:
                floor = int(best.min()) if floor is None else max(floor, int(best.min()))
        order = np.lexsort((self.ids[best_at], -best))
        return self.ids[best_at[order]].tolist(), best[order].tolist()

    @staticmethod
    def _essential(rest: np.ndarray, floor: int | None) -> int:
        """How many of the weightiest terms are essential: all others together stay below the floor."""
        return len(rest) - 1 if floor is None else min(len(rest) - 1, int(np.searchsorted(-rest, -floor, side="right")))

    def _first_floor(self, query: np.ndarray, terms: np.ndarray, other: np.ndarray, k: int) -> int | None:
        """The k-th score among candidates with large components in the weightiest terms; None with fewer than k."""
        if other.sum() < k:
            return None
        start = np.zeros(len(self.ids), np.int64)
        for t in terms[:4]:
            start += query[t] * self.columns[t]
        start[~other] = np.iinfo(np.int64).min
        some = min(int(other.sum()), max(64, 4 * k))
        picked = np.argpartition(start, len(start) - some)[len(start) - some:]
        scores = query @ self.columns[:, picked]
        return int(np.partition(scores, some - k)[some - k])


def top_embeddings(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` best inner products of the vectors whose id is divisible by ``every``."""
    return top_k(integer_vectors(embeddings, "vec_id", "embedding"), F.col("id") % every == 0, k)
