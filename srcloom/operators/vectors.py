"""Nearest-vector search over a vector table: exact, or in random-projection buckets.

Both kinds work in cells. A cell is a bounded part of the vectors and a bounded part of the queries that have to meet; one
matrix product finds each query's candidates in it and exact differences rank them. Cells form a grid over each key (the
length of the vectors, or a group of buckets): rows are dealt to the grid's lines, queries to its columns, by their place of
reading, so neither a common vector nor a full bucket makes a large cell. A query has at most k rows of each cell, and
these are ranked in two steps, of which Spark does the first before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from srcloom.session import ship_package

TOP_K = 5
# Bytes of vectors, as doubles, on either side of a cell.
CELL_BYTES = 4 << 20
# Candidates beyond k that are ranked exactly.
SPARE = 3
# Bytes of distances that a task holds at a time, pairs that it holds before it keeps the k best of each query, and queries
# whose buckets it finds at a time.
BLOCK_BYTES, PAIRS, PROBED = 8 << 20, 200_000, 64
# Buckets: tables of 2^BITS buckets each, the share of a table's buckets that a query looks into, and
# the leading bits of a bucket that name its cell.
TABLES, BITS, SHARE, GROUP_BITS = 4, 12, 0.16, 3
SEED = 20240501


def squared_distance(vector: Column, query: Sequence[float]) -> Column:
    """Squared Euclidean distance in double precision, as a flat L2 index ranks by."""
    point = F.array(*[F.lit(float(x)) for x in query])
    squares = F.zip_with(vector, point, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def comparable(vectors: DataFrame, dims: int, vector_column: str = "embedding") -> DataFrame:
    """Rows with a vector of the given length; null ones and others have no distance."""
    return vectors.where(F.col(vector_column).isNotNull() & (F.size(vector_column) == dims))


def search(
    vectors: DataFrame,
    query: Sequence[float],
    k: int = TOP_K,
    where: Column | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The k nearest rows to one query vector; filters apply before ranking, ties go by id."""
    pool = comparable(vectors if where is None else vectors.where(where), len(query), vector_column)
    scored = pool.withColumn("distance", squared_distance(F.col(vector_column), query))
    return scored.orderBy("distance", id_column).limit(k)


def _whole(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull())


def _rows(vectors: DataFrame, where: Column | None, id_column: str, vector_column: str, *more: Column) -> DataFrame:
    """(read, dims, id, v, ...) of the rows that have a vector without nulls."""
    pool = (vectors if where is None else vectors.where(where)).where(_whole(F.col(vector_column)))
    return pool.select(
        F.monotonically_increasing_id().alias("read"),
        F.size(vector_column).alias("dims"),
        F.col(id_column).alias("id"),
        F.col(vector_column).alias("v"),
        *more,
    )


def _points(queries: DataFrame) -> DataFrame:
    return queries.where(_whole(F.col("query"))).select(
        F.monotonically_increasing_id().alias("read"), F.size("query").alias("dims"), "query_id", F.col("query").alias("q")
    )


def _dealt(rows: DataFrame, cells: DataFrame, own: str, other: str) -> DataFrame:
    """Rows in one part of their key's own side, and in each part of the other."""
    placed = rows.join(F.broadcast(cells), ["dims", "cell"]).withColumn(own, F.pmod("read", own))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("read")


def _met(rows: DataFrame, points: DataFrame, k: int, id_column: str, work: Callable, rank: Column) -> DataFrame:
    """Rows (.., cell, ..) and points (.., cell, ..) meet by dims and cell; the k best of all for each query."""
    spark = rows.sparkSession
    ship_package(spark)
    per_side = F.greatest(F.lit(1), F.lit(CELL_BYTES) / (8 * F.col("dims")))
    # One row for each length of vectors and bucket group: lengths that differ are few, as d of them need d * d / 2 numbers.
    counts = rows.groupBy("dims", "cell").agg(F.count("*").alias("r")).join(
        points.groupBy("dims", "cell").agg(F.count("*").alias("c")), ["dims", "cell"]
    )
    cells = counts.select("dims", "cell", *[F.ceil(F.col(n) / per_side).cast("long").alias(n) for n in ("r", "c")])
    schema = StructType(
        [
            StructField("query_id", points.schema["query_id"].dataType),
            StructField(id_column, rows.schema["id"].dataType),
            StructField("distance", DoubleType()),
        ]
    )
    names = schema.names

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({n: pa.array([], t.type) for n, t in zip(names, [right.schema.field("query_id"), left.schema.field("id"), pa.field("d", pa.float64())])})
        # Ties go by id, which is by place from here on.
        left = left.take(pc.sort_indices(left.column("id")))
        which, found, distance = work(left, right, k)
        columns = [right.column("query_id").take(pa.array(which)), left.column("id").take(pa.array(found)), pa.array(distance)]
        return pa.table(columns, names=names)

    key = ["dims", "cell", "r", "c"]
    left, right = _dealt(rows, cells, "r", "c").groupBy(*key), _dealt(points, cells, "c", "r").groupBy(*key)
    nearest = left.cogroup(right).applyInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy("distance", id_column)
    return nearest.withColumn("rank", rank.over(best)).where(F.col("rank") <= k)


def search_many(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    where: Column | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The k nearest rows for each row (query_id, query) of a query table, exactly; ids of any type.

    No pair of query and vector is ever a row, and no table passes through the driver. Vectors and queries that are null
    or hold a null are left out; those of different lengths do not meet.
    """
    whole = F.lit(0).alias("cell")
    rows = _rows(vectors, where, id_column, vector_column, whole)
    return _met(rows, _points(queries).select("*", whole), k, id_column, _all_of_a_cell, F.row_number())


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = pc.list_flatten(column)
    values = flat.to_numpy().astype(np.float64)
    return values.reshape(len(column), -1)


def nearest(own: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and squared distance of the k nearest rows of each query, ties by place.

    The matrix product loses digits, so it only picks candidates: a few more than k, or all within its error of the k-th
    distance where those are not enough. Candidates are ranked by exact differences. Queries are taken a block at a time,
    so that distances to all rows never take more than ``BLOCK_BYTES``, or one query's.
    """
    squares = (own**2).sum(1)
    k = min(k, len(own))
    block = max(1, BLOCK_BYTES // (8 * max(len(own), min(len(own), k + SPARE) * own.shape[1])))
    found, distance = np.empty((len(wanted), k), np.int64), np.empty((len(wanted), k))
    for at in range(0, len(wanted), block):
        part = slice(at, at + block)
        found[part], distance[part] = _nearest_of_block(own, squares, wanted[part], k)
    return np.repeat(np.arange(len(wanted)), k), found.ravel(), distance.ravel()


def _nearest_of_block(own: np.ndarray, squares: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and squared distances of the k nearest, a line for each query."""
    sizes = (wanted**2).sum(1)
    rough = wanted @ own.T
    rough *= -2
    rough += sizes[:, None] + squares
    slack = 1e-9 * (sizes + squares.max() + 1)
    wide = min(len(own), k + SPARE)
    if wide < len(own):
        chosen = np.sort(np.argpartition(rough, wide - 1, axis=1)[:, :wide], axis=1)
    else:
        chosen = np.broadcast_to(np.arange(wide), (len(wanted), wide))
    exact = ((own[chosen] - wanted[:, None, :]) ** 2).sum(2)
    best = np.argsort(exact, axis=1, kind="stable")[:, :k]
    found, distance = np.take_along_axis(chosen, best, 1), np.take_along_axis(exact, best, 1)
    if wide < len(own):
        reach = np.take_along_axis(rough, chosen, 1).max(1)
        for q in np.flatnonzero(reach <= distance[:, -1] + slack).tolist():
            near = np.flatnonzero(rough[q] <= distance[q, -1] + slack[q])
            all_near = ((own[near] - wanted[q]) ** 2).sum(1)
            order = np.argsort(all_near, kind="stable")[:k]
            found[q], distance[q] = near[order], all_near[order]
    return found, distance


def _all_of_a_cell(left: pa.Table, right: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return nearest(matrix(left.column("v")), matrix(right.column("q")), k)


# --- buckets -----------------------------------------------------------------------------------------


def planes(dims: int, tables: int, bits: int) -> np.ndarray:
    """Directions of each table's bits; those of a table are orthogonal as far as the length allows."""
    drawn = np.random.default_rng([SEED, dims]).normal(size=(tables, bits, dims))
    return np.stack([np.linalg.qr(t.T)[0].T if bits <= dims else t for t in drawn])


def with_buckets(
    vectors: DataFrame, vector_column: str = "embedding", name: str = "buckets", tables: int = TABLES, bits: int = BITS
) -> DataFrame:
    """Adds the bucket of each vector in each table, an array that is stored with the row; null for null vectors."""
    ship_package(vectors.sparkSession)

    @F.pandas_udf(ArrayType(IntegerType()))
    def buckets(column: pd.Series) -> pd.Series:
        known: dict[int, np.ndarray] = {}
        found = []
        for v in column:
            whole = v is not None and len(v) > 0
            if whole and len(v) not in known:
                known[len(v)] = planes(len(v), tables, bits)
            signs = known[len(v)] @ np.asarray(v, np.float64) > 0 if whole else None
            found.append((signs @ (1 << np.arange(bits))).astype(np.int32) if whole else None)
        return pd.Series(found)

    return vectors.withColumn(name, buckets(vector_column))


def _probes(points: DataFrame, tables: int, bits: int, share: float) -> DataFrame:
    """(dims, read, query_id, q, cell, probed): the buckets in each cell that a query looks into. Those go first that
    need the least change of the query to be its own."""
    schema = StructType(
        [
            *points.select("read", "dims", "query_id", "q").schema.fields,
            StructField("cell", IntegerType()),
            StructField("probed", ArrayType(IntegerType())),
        ]
    )
    every = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    many, shift = max(1, int(share * (1 << bits))), max(0, bits - GROUP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in (whole.slice(at, PROBED) for whole in batches for at in range(0, whole.num_rows, PROBED)):
            rows, cells, probed, ends = [], [], [], [0]
            for i, v in enumerate(batch.column(3).to_pylist()):
                if len(v) not in known:
                    known[len(v)] = planes(len(v), tables, bits)
                for t, table in enumerate(known[len(v)]):
                    margins = table @ np.asarray(v, np.float64)
                    cost = ((every != (margins > 0)) * margins**2).sum(1)
                    chosen = np.sort(np.argpartition(cost, many - 1)[:many])
                    groups, starts = np.unique(chosen >> shift, return_index=True)
                    rows += [i] * len(groups)
                    cells += (t << GROUP_BITS | groups).tolist()
                    ends += (ends[-1] + np.append(starts[1:], many)).tolist()
                    probed.append(chosen)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(probed), pa.int32()))
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(cells, pa.int32()), lists], names=schema.names)

    return points.select("read", "dims", "query_id", "q").mapInArrow(run, schema)


def _buckets_of_a_cell(left: pa.Table, right: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, wanted = matrix(left.column("v")), matrix(right.column("q"))
    lists = right.column("probed").combine_chunks()
    asked = np.repeat(np.arange(len(wanted)), pc.list_value_length(lists).to_numpy())
    probed = pc.list_flatten(lists).to_numpy()
    order = np.argsort(probed, kind="stable")
    asked, probed = asked[order], probed[order]
    bucket = left.column("bucket").to_numpy()
    members = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[members])) + 1
    parts, pairs = [], 0
    for rows in np.split(members, edges):
        a, b = np.searchsorted(probed, [bucket[rows[0]], bucket[rows[0]] + 1])
        if a < b:
            which, found, distance = nearest(own[rows], wanted[asked[a:b]], k)
            parts.append((asked[a:b][which], rows[found], distance))
            pairs += len(which)
            if pairs > PAIRS:
                parts = [_best(parts, k)]
                pairs = len(parts[0][0]) // 2
    return _best(parts, k)


def _best(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query in lists of queries, rows and distances, ties by place."""
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    which, found, distance = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((found, distance, which))
    which, found, distance = which[order], found[order], distance[order]
    heads = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    place = np.arange(len(which)) - np.repeat(heads, np.diff(np.append(heads, len(which))))
    return which[place < k], found[place < k], distance[place < k]


def search_buckets(
    indexed: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    share: float = SHARE,
    where: Column | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    name: str = "buckets",
    tables: int = TABLES,
    bits: int = BITS,
) -> DataFrame:
    """The k nearest rows of those in the buckets that each query looks into, ranked by exact distance.

    ``indexed`` has the buckets of ``with_buckets`` in a column. Each table offers a query ``share`` of its buckets; a
    near vector is missed only if no table offers it.
    """
    shift = max(0, bits - GROUP_BITS)
    rows = _rows(indexed, where, id_column, vector_column, F.posexplode(name).alias("table", "bucket"))
    cell = F.shiftleft("table", GROUP_BITS).bitwiseOR(F.shiftright("bucket", shift)).alias("cell")
    rows = rows.select("read", "dims", "id", "v", "bucket", cell)
    points = _probes(_points(queries), tables, bits, share)
    # A row may come from several tables; it has the same rank each time.
    return _met(rows, points, k, id_column, _buckets_of_a_cell, F.dense_rank()).distinct()


def recall(exact: DataFrame, found: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """(wanted, met, recall): how many of the exact rows (query_id, id) were found."""
    met = exact.join(found.select("query_id", id_column, F.lit(1).alias("hit")), ["query_id", id_column], "left")
    return met.agg(F.count("*").alias("wanted"), F.count("hit").alias("met")).withColumn(
        "recall", F.try_divide("met", "wanted")
    )


def looked_into(indexed: DataFrame, queries: DataFrame, share: float = SHARE, tables: int = TABLES, bits: int = BITS, name: str = "buckets") -> DataFrame:
    """(queries, vectors, looked, share): how many vectors, counted once for each table, the queries are compared with,
    and their share of all pairs of query and vector. Counts alone meet, by bucket."""
    full = indexed.where(F.col(name).isNotNull()).select(F.posexplode(name).alias("table", "bucket"))
    sizes = full.groupBy("table", "bucket").count()
    asked = _probes(_points(queries), tables, bits, share).select(
        "query_id", F.shiftright("cell", GROUP_BITS).alias("table"), F.explode("probed").alias("bucket")
    )
    asked = asked.groupBy("table", "bucket").agg(F.count("*").alias("times"))
    zero = F.lit(0).cast("long")
    looked = asked.join(sizes, ["table", "bucket"]).select(zero.alias("q"), zero.alias("v"), (F.col("times") * F.col("count")).alias("n"))
    own = indexed.where(F.col(name).isNotNull()).select(zero, F.lit(1).cast("long"), zero)
    sums = queries.select(F.lit(1).cast("long").alias("q"), zero.alias("v"), zero.alias("n")).unionAll(own).unionAll(looked).agg(
        F.sum("q").alias("queries"), F.sum("v").alias("vectors"), F.sum("n").alias("looked")
    )
    return sums.withColumn("share", F.try_divide("looked", F.col("queries") * F.col("vectors")))


def mean_vectors(vectors: DataFrame, group: str, vector_column: str = "embedding") -> DataFrame:
    """Mean vector per group as (query_id, query), summed on the map side as vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    points = vectors.where(F.col(vector_column).isNotNull()).select(
        F.col(group).cast("bigint").alias("query_id"),
        array_to_vector(F.col(vector_column).cast("array<double>")).alias("_v"),
    )
    means = points.groupBy("query_id").agg(Summarizer.mean(F.col("_v")).alias("_mean"))
    return means.select("query_id", vector_to_array("_mean").alias("query"))


def retrieval_accuracy(nearest: DataFrame, relevant: Column) -> DataFrame:
    """Share of queries with a relevant row among their nearest."""
    per_query = nearest.groupBy("query_id").agg(F.bool_or(relevant).alias("hit"))
    return per_query.agg(
        F.count("*").alias("queries"),
        F.count_if("hit").alias("hits"),
    ).withColumn("accuracy", F.round(F.col("hits") / F.col("queries"), 6))
