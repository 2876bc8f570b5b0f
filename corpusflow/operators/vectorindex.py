"""A stored index of vectors: rows in partitions by the nearest of some centroids, of which a search reads a few.

The centroids are fitted on a bounded sample, every row is indexed. A question is compared with the rows
of its nearest cells only, by their exact cosine; how many cells that takes is found on the sample, from
the recall that is wanted. With as many probes as there are cells the search is exact. The table of centroids is written last, so a folder without it is no index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from ..settings import SearchSettings
from .scoring import Best, unit_rows
from .search import ranked


@dataclass(frozen=True)
class VectorIndexSettings:
    rows_per_cell: int = 2_000  # wanted; the number of cells follows, within the bounds
    least_cells: int = 16
    most_cells: int = 4_096
    sample: int = 50_000  # rows at most that the centroids are fitted on
    rounds: int = 12  # of fitting
    recall: float = 0.95  # of the nearest rows that the sample's own questions must find
    trials: int = 300  # rows of the sample that are asked to find the number of probes
    neighbours: int = 40  # nearest rows of a trial
    probes: int | None = None  # cells that a question is compared with, in place of the number found
    seed: int = 7


def fit_centroids(vectors: np.ndarray, cells: int, settings: VectorIndexSettings) -> np.ndarray:
    """Unit centroids by spherical k-means; an emptied cell restarts at a row far from its own."""
    rng = np.random.default_rng(settings.seed)
    cells = max(1, min(cells, len(vectors)))
    centers = vectors[rng.choice(len(vectors), cells, replace=False)]
    for _ in range(settings.rounds):
        scores = vectors @ centers.T
        near = scores.argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, vectors)
        empty = np.flatnonzero(np.bincount(near, minlength=cells) == 0)
        sums[empty] = vectors[np.argsort(scores.max(axis=1))[: len(empty)]]
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centers


def enough_probes(sample: np.ndarray, centers: np.ndarray, settings: VectorIndexSettings) -> int:
    """The fewest probes with which the sample's rows find ``recall`` of their nearest rows in it."""
    asked = sample[np.random.default_rng(settings.seed + 1).choice(len(sample), min(settings.trials, len(sample)), replace=False)]
    k = min(settings.neighbours, len(sample))
    nearest = np.argpartition(-(asked @ sample.T), k - 1, axis=1)[:, :k]
    turn = np.argsort(np.argsort(-(asked @ centers.T), axis=1, kind="stable"), axis=1)  # when each cell is probed
    found = np.sort(np.take_along_axis(turn, (sample @ centers.T).argmax(axis=1)[nearest], 1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(settings.recall * len(found))))]) + 1


def build(vectors: DataFrame, folder: str, settings: VectorIndexSettings = VectorIndexSettings(), key: str = "chunk_id", vector: str = "dense") -> None:
    """Writes the index of ``vectors`` with all their columns.

    Null, empty and zero vectors lie in cell 0; vectors must be of one length. Rows go to their cells
    in pieces of even size, so a cell that holds a third of all rows is several files. An empty
    table makes an index that finds nothing.
    """
    spark, total = vectors.sparkSession, vectors.count()
    rate = min(1.0, 1.2 * settings.sample / max(1, total))
    drawn = vectors.where(F.size(vector) > 0).where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(rate * 1_000_000)).select(vector).limit(settings.sample).toArrow()
    held = drawn.column(0).combine_chunks()
    width = len(held[0]) if len(held) else 0
    sample = unit_rows(held, width) if len(held) else np.zeros((1, 0))
    cells = int(np.clip(total // settings.rows_per_cell, settings.least_cells, settings.most_cells))
    centers = fit_centroids(sample, cells, settings)
    probes = enough_probes(sample, centers, settings)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (unit_rows(batch.column(vector), width) @ centers.T).argmax(axis=1) if width else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=[*batch.schema.names, "cell"])

    placed = vectors.mapInArrow(place, StructType([*vectors.schema.fields, StructField("cell", IntegerType())]))
    if total:
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/rows")
    else:  # one file without rows tells the columns
        placed.write.parquet(f"{folder}/rows")
    table = [(cell, center, probes) for cell, center in enumerate(centers.tolist())]
    spark.createDataFrame(table, "cell int, center array<double>, probes int").coalesce(1).write.parquet(f"{folder}/centers")


def read_centers(spark: SparkSession, folder: str, settings: VectorIndexSettings) -> tuple[np.ndarray, int]:
    """The centroids in the order of their cells, at most ``most_cells``, and the number of probes."""
    rows = spark.read.parquet(f"{folder}/centers").orderBy("cell").collect()
    return np.array([r["center"] for r in rows], np.float64), settings.probes or rows[0]["probes"]


def probe(vectors: list, centers: np.ndarray, probes: int) -> np.ndarray:
    """``questions x probes``: the nearest cells of each question."""
    kind = pa.list_(pa.float64())
    scores = unit_rows(pa.array(vectors, kind), centers.shape[1]) @ centers.T
    return np.argsort(-scores, axis=1, kind="stable")[:, : min(probes, len(centers))]


def search(
    folder: str, queries: DataFrame, k: int, settings: VectorIndexSettings = VectorIndexSettings(), searching: SearchSettings = SearchSettings(), key: str = "chunk_id", query: str = "query_id", vector: str = "dense"
) -> DataFrame:
    """``(query, key, score, rank)``: of each query the ``k`` nearest rows of its ``probes`` nearest cells.

    Only the partitions of cells that some query probes are read, and each row is multiplied with
    those queries only. Queries go to the tasks in passes, as in ``search.top_lists``.
    """
    spark, out = queries.sparkSession, None
    (centers, probes), stored = read_centers(spark, folder, settings), spark.read.parquet(f"{folder}/rows")
    width, id_kind = centers.shape[1], to_arrow_type(queries.schema[query].dataType)
    passes = max(1, -(-queries.count() // searching.broadcast_queries))
    for n in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64(query), F.lit(passes)) == n)
        asked = part.select(query, vector).collect()  # about broadcast_queries
        ids, vectors = [r[query] for r in asked], [r[vector] for r in asked]
        cells = probe(vectors, centers, probes) if asked else np.zeros((0, 0), np.int64)
        unit = unit_rows(pa.array(vectors, pa.list_(pa.float64())), width)
        by_cell = {int(c): np.flatnonzero((cells == c).any(axis=1)) for c in np.unique(cells)}

        def top(batches: Iterator[pa.RecordBatch], ids: list = ids, unit: np.ndarray = unit, by_cell: dict = by_cell) -> Iterator[pa.RecordBatch]:
            best, kind = Best(len(ids), k, -np.inf), None
            for batch in batches:
                kind, held = batch.schema.field(key).type, batch.column("cell").to_numpy(zero_copy_only=False)
                for cell in np.unique(held):
                    which, mine = by_cell[int(cell)], batch.take(pa.array(np.flatnonzero(held == cell)))
                    step = max(1, searching.product_cells // len(which))
                    for at in range(0, mine.num_rows, step):
                        block = mine.slice(at, step)
                        best.add(block.column(key), np.round(unit_rows(block.column(vector), width) @ unit[which].T, 6), which)
            if kind is not None:
                rows = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in rows["q"]], id_kind), pa.array(rows["key"], kind), pa.array(rows["score"] + 0.0, pa.float64())], names=[query, key, "score"])

        near = stored.where(F.col("cell").isin(*by_cell) if by_cell else F.lit(False)).select(key, vector, "cell")
        found = near.mapInArrow(top, f"{query} {dict(queries.dtypes)[query]}, {key} {dict(stored.dtypes)[key]}, score double")
        out = found if out is None else out.unionByName(found)
    return ranked(out, [query], key, k)


def share_read(folder: str, queries: DataFrame, settings: VectorIndexSettings = VectorIndexSettings(), vector: str = "dense") -> float:
    """The share of all pairs of a row and a query (a bounded set) that a search compares."""
    spark = queries.sparkSession
    sizes = {r["cell"]: r["n"] for r in spark.read.parquet(f"{folder}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most most_cells
    cells = probe([r[0] for r in queries.select(vector).collect()], *read_centers(spark, folder, settings))
    return sum(sizes.get(int(c), 0) for c in cells.ravel()) / max(1, len(cells) * sum(sizes.values()))
