"""Exact top-k by inner product: a Voronoi join of queries and data.

Data fall to their nearest pivot. A cell is summed up by its size and radius;
for a query q, a cell with pivot p and radius r holds scores between
q.p - |q| r and q.p + |q| r. Each query is first solved in its most promising
cell, which gives a score that the answer must reach, and then goes only to
cells whose bound reaches it. Cells and queries are cut into blocks of bounded
size, so a very common vector fills many blocks and no task holds a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from needscope.sources.scratch import settle

BLOCK_ROWS = 2_000  # data of a block; also of a cell while there are few enough
MOST_PIVOTS = 1_024  # pivots and cell summaries that the driver holds
QUERY_ROWS = 2_048  # queries of a block


def scaled_vectors(vectors: DataFrame, id: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, v): components as floor(scale * x). Rows with a null id, a null or
    empty vector, or a null or non-finite component are left out."""
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)
    doubles = F.col(vector).cast("array<double>")
    return (
        vectors.select(F.col(id).cast("long").alias("id"), doubles.alias("v"))
        .where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
        .select("id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))
    )


def top_k(queries: DataFrame, data: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` and ``data`` of (id, v).

    Every data row competes for every query of another id. Ties go to the
    smaller id; all rows are returned if there are fewer than k. Repeated data
    rows compete each for itself. Equal repeated queries are one query;
    queries of one id with different vectors are answered separately. Shorter
    vectors count as ending in zeros. Empty tables give no rows.
    """
    data = settle(data, "vectors")
    asked = settle(queries.dropDuplicates(["id", "v"]).withColumn("key", F.xxhash64("id", "v")), "queries")
    count, width = data.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    pivots = _pivots(data, min(MOST_PIVOTS, max(8, -(-count // BLOCK_ROWS))), width)
    cells = settle(_assigned(data, pivots, width), "cells")
    summary = cells.groupBy("cell").agg(F.count("*").alias("rows"), F.max("distance").alias("radius")).toPandas()
    rows, radius = np.zeros(len(pivots)), np.zeros(len(pivots))
    rows[summary["cell"]], radius[summary["cell"]] = summary["rows"], summary["radius"]
    # a query's own rows don't compete, so so many more must stand behind a bound
    full = k + (data.groupBy("id").count().agg(F.max("count")).first()[0] or 1)

    query_blocks = max(1, -(-asked.count() // QUERY_ROWS))
    first = _solved(_routed(asked, pivots, rows, radius, width, full, None, query_blocks), cells, rows, width, k)
    first = settle(first, "first-scores")
    reached = first.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    bounded = asked.join(reached, "key", "left")
    rest = _solved(_routed(bounded, pivots, rows, radius, width, full, "least", query_blocks), cells, rows, width, k)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    best = first.unionByName(rest).withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, short ones padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [values])] = values
    return out


def _pivots(data: DataFrame, most: int, width: int) -> np.ndarray:
    """Distinct vectors with the smallest hashes: the same for any row order."""
    distinct = data.select("v").groupBy("v").agg(F.first(F.xxhash64("v")).alias("h"))
    found = [row["v"] + [0] * (width - len(row["v"])) for row in distinct.orderBy("h").limit(most).collect()]
    return np.array(found or [[0] * width], np.float64)


def _assigned(data: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(1) / 2
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column(1), width).astype(np.float64)
            cell = np.argmin(half - points @ pivots.T, 1)
            distance = np.sqrt(((points - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distance)], ["id", "v", "cell", "distance"])

    return data.select("id", "v").mapInArrow(assign, "id long, v array<long>, cell int, distance double")


def _routed(
    asked: DataFrame, pivots: np.ndarray, rows: np.ndarray, radius: np.ndarray, width: int, full: int, least: str | None, blocks: int
) -> DataFrame:
    """Queries with the cells to visit. Without ``least``: the one most
    promising cell; with it: all other cells whose bound reaches it."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column(1), width).astype(np.float64)
            middle = points @ pivots.T
            length = np.sqrt((points**2).sum(1))[:, None]
            slack = 1e-9 * (1 + np.abs(middle) + length * radius)  # rounding of the bounds themselves
            most, low = middle + length * radius + slack, middle - length * radius - slack
            most[:, rows == 0] = -np.inf
            home = np.argmax(np.where(rows >= full, most, most - 1e300), 1)  # a cell that can fill the list, if any
            if least is None:
                visits = np.zeros(most.shape, bool)
                visits[np.arange(len(home)), home] = True
            else:
                known = np.array([np.nan if x is None else x for x in batch.column(3).to_pylist()], float)
                order = np.argsort(-low, 1)
                filled = np.cumsum(rows[order], 1) >= full
                summed = np.where(filled.any(1), np.take_along_axis(low, order, 1)[np.arange(len(low)), np.argmax(filled, 1)], -np.inf)
                visits = most >= np.where(np.isnan(known), summed, known)[:, None]
                visits[:, rows == 0] = False
                visits[np.arange(len(home)), home] = False
            at, cell = np.nonzero(visits)
            yield pa.RecordBatch.from_arrays([*batch.select([0, 1, 2]).take(pa.array(at)).columns, pa.array(cell.astype(np.int32))], ["id", "v", "key", "cell"])

    columns = ["id", "v", "key", *([least] if least else [])]
    routes = asked.select(*columns).mapInArrow(route, "id long, v array<long>, key long, cell int")
    return routes.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))


def _solved(routes: DataFrame, cells: DataFrame, rows: np.ndarray, width: int, k: int) -> DataFrame:
    """Best k of each query in each block of each cell it visits."""
    routes = settle(routes, "routes")
    parts = np.maximum(1, -(-rows // BLOCK_ROWS)).astype(int).tolist()
    pieces = F.get(F.array(*[F.lit(n) for n in parts]), F.col("cell"))
    needed = routes.select(F.col("cell").alias("to"), F.col("block").alias("for")).distinct()
    held = cells.withColumn("part", F.pmod(F.xxhash64("id"), pieces).cast("int")).join(needed, F.col("cell") == F.col("to"))
    sent = routes.withColumn("part", F.explode(F.sequence(F.lit(0), pieces - 1)))
    keys = ("cell", "part", "block")

    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        ids, keys_ = queries["id"].to_numpy(), queries["key"].to_numpy()
        others = data["id"].to_numpy()
        names = ["key", "query_id", "vec_id", "score"]
        if not len(ids) or not len(others):
            return pa.table([pa.array([], pa.int64())] * 4, names)
        scores = exact_products(_matrix(queries["v"].combine_chunks(), width), _matrix(data["v"].combine_chunks(), width))
        order = np.argsort(others, kind="stable")
        others, scores = others[order], scores[:, order]
        out: list[list[np.ndarray]] = [[], [], [], []]
        for i, own in enumerate(ids):
            open_ = np.flatnonzero(others != own)
            found = scores[i, open_]
            if len(found) > k:
                edge = np.partition(found, len(found) - k)[len(found) - k]
                above, level = np.flatnonzero(found > edge), np.flatnonzero(found == edge)
                pick = np.r_[above, level[: k - len(above)]]
            else:
                pick = np.arange(len(found))
            for column, value in zip(out, (np.full(len(pick), keys_[i]), np.full(len(pick), own), others[open_[pick]], found[pick])):
                column.append(value)
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names)

    data = held.select("cell", "part", "for", "id", "v")
    grouped = sent.select(*keys, "id", "v", "key").groupBy(*keys).cogroup(data.groupBy("cell", "part", "for"))
    return grouped.applyInArrow(solve, "key long, query_id long, vec_id long, score long")


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products, clipped to 64 bits.

    Doubles are exact while every sum stays under 2**53; beyond that Python's
    integers do the work.
    """
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    largest = int(np.abs(left).max()) * int(np.abs(right).max()) * left.shape[1]
    if 0 <= largest < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    whole = left.astype(object) @ right.astype(object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)
