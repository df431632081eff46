"""Approximate nearest neighbours by inner product (operator 4).

Vectors are projected several times and ordered along shifted Hilbert curves.
Spark's range partitioning sorts each curve, of which only ids take part; ranks
cut it into blocks of equal size, blocks of queries meet the blocks of
candidates around them, and each query is scored against the ranks inside its
window.  The windows of all curves merge and are ranked by exact scores.  How
far a window reaches is set by measuring a bounded sample of queries against
all rows, so that the wanted recall is met on these data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .held import tidy
from .hilbert import Curves
from .sampling import sampled
from .scratch import Scratch

NEIGHBOURS = 20
CURVES, AXES, AXIS_BITS = 32, 8, 7
#: Rows of a block of a curve; a task holds so many queries and so many candidates at most.
BLOCK = 4096
#: Ranks that a window reaches to either side at least.
LEAST_REACH = 512
#: How far a fast score may lie from the exact one, for vectors of length 1.
MARGIN = 1e-9
#: Vectors the curves are fitted on, and queries the windows are measured with, at most.
SAMPLE, PROBES = 4096, 96
#: Share of true neighbours that some curve must hold inside the window.
RECALL = 0.95


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector of the rows that take part, each once: finite, not zero, of the usual length."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    good = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~odd & some)
    lengths = good.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    return good.where(F.size("embedding") == (usual.length if usual else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).distinct()


def _lift(vectors: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors with one more axis, on which largest inner product is nearest angle."""
    square = (vectors**2).sum(1)
    if query:
        return np.hstack([vectors / np.sqrt(square)[:, None], np.zeros((len(vectors), 1))])
    return np.hstack([vectors / longest, np.sqrt(np.maximum(0.0, 1 - square / longest**2))[:, None]])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sequential(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in the vectors' order: the same for the same two vectors, whatever stands beside them."""
    total = np.zeros(len(left))
    for x, y in zip(left.T, right.T, strict=True):
        total += x * y
    return total


def _order(classes: DataFrame, queries: DataFrame, curves: Curves, longest: float, scratch: Scratch) -> DataFrame:
    """curve, rank, role, id: every class (role 0) and query (role 1) at its place on every curve."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(curves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            role = batch.column(0).to_numpy()
            vectors = _matrix(batch.column(2))
            lifted = np.where((role == 1)[:, None], _lift(vectors, longest, True), _lift(vectors, longest, False))
            for number, keys in enumerate(shared.value.keys(lifted)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number, np.int32)), pa.array(keys), *batch.columns[:2]], ["curve", "key", "role", "id"])

    both = classes.select(F.lit(0).alias("role"), "id", "vector").unionByName(queries.select(F.lit(1).alias("role"), "id", "vector"))
    keyed = both.mapInArrow(tidy(place), "curve int, key long, role int, id long")
    ordered = keyed.repartitionByRange("curve", "key", "id", "role").sortWithinPartitions("curve", "key", "id", "role")
    placed = ordered.select("curve", "role", "id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    placed = scratch.keep(placed, "placed")
    parts = placed.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("from"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("offset", ahead - F.col("from")).select("curve", "part", "offset")
    return placed.join(parts, ["curve", "part"]).select("curve", (F.col("at") + F.col("offset")).alias("rank"), "role", "id")


def _exact(classes: DataFrame, probes: list[tuple[int, list[float]]], most: int) -> DataFrame:
    """probe, id: the best classes of a bounded list of queries, by blocks over all classes."""
    shared = classes.sparkSession.sparkContext.broadcast((np.array([p[0] for p in probes]), np.array([p[1] for p in probes], np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted = shared.value
        best_id, best = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
        for batch in batches:
            if batch.num_rows:
                ids = np.broadcast_to(batch.column(0).to_numpy(), (len(names), batch.num_rows))
                best_id = np.hstack([best_id, ids])
                best = np.hstack([best, wanted @ _matrix(batch.column(1)).T])
                top = np.argsort(-best, axis=1, kind="stable")[:, :most]
                best_id, best = np.take_along_axis(best_id, top, 1), np.take_along_axis(best, top, 1)
        yield pa.RecordBatch.from_pydict({"probe": np.repeat(names, best.shape[1]), "id": best_id.ravel(), "score": best.ravel()})

    found = classes.select("id", "vector").mapInArrow(score, "probe long, id long, score double")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("probe", "id")


def _reach(placed: DataFrame, classes: DataFrame, queries: DataFrame, most: int, recall: float) -> int:
    """Ranks a window must reach to either side for the wanted share of the sampled queries' true neighbours."""
    probes = [(r.id, r.vector) for r in sampled(queries.select("id", "vector"), PROBES)]
    if not probes:
        return 1
    names = [p[0] for p in probes]
    true = _exact(classes, probes, most)
    queried = placed.where((F.col("role") == 1) & F.col("id").isin(names)).select("curve", F.col("id").alias("probe"), F.col("rank").alias("own"))
    away = true.join(placed.where("role = 0").select("curve", "id", "rank"), "id").join(queried, ["curve", "probe"])
    nearest = away.groupBy("probe", "id").agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("away"))
    found = sorted(r.away for r in nearest.select("away").collect())  # at most PROBES * most
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) if found else 1


def _scored(placed: DataFrame, classes: DataFrame, queries: DataFrame, reach: int, keep: int) -> DataFrame:
    """query, id, least, score: the best classes of each query inside its window on each curve.

    A block of queries meets each block of candidates that some window reaches.
    Fast products choose the candidates that may be among the best, exact ones
    order them, ties by the smaller vec_id, so the cut is by the final order.
    """
    block = lambda x: F.floor(x / BLOCK).cast("int")
    around = F.sequence(F.greatest(F.lit(0), block(F.col("rank") - reach)), block(F.col("rank") + reach))
    vectors = classes.select("id", "vector", F.col("ids")[0].alias("least"))
    offered = placed.where("role = 0").select("curve", "rank", "role", "id", F.explode(around).alias("own"), block(F.col("rank")).alias("block")).join(vectors, "id")
    asking = placed.where("role = 1").select("curve", "rank", "role", "id", block(F.col("rank")).alias("own"), F.explode(around).alias("block"))
    asking = asking.join(queries.select("id", "vector", F.col("query_id").alias("least")), "id")

    def best(table: pa.Table) -> pa.Table:
        role, rank, ids, least = (table.column(c).to_numpy() for c in ("role", "rank", "id", "least"))
        vectors = _matrix(table.column("vector").combine_chunks())
        offered, wanted = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        offered = offered[np.argsort(rank[offered], kind="stable")]
        own, candidates = vectors[wanted], vectors[offered]
        size = np.sqrt((candidates**2).sum(1).max(initial=0.0))
        lows = np.searchsorted(rank[offered], rank[wanted] - reach)
        highs = np.searchsorted(rank[offered], rank[wanted] + reach, "right")
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for number, (low, high) in enumerate(zip(lows, highs, strict=True)):
            if high > low:
                fast = candidates[low:high] @ own[number]
                cut = np.partition(fast, high - low - keep)[high - low - keep] if high - low > keep else -np.inf
                some = low + np.flatnonzero(fast >= cut - MARGIN * size * np.sqrt((own[number] ** 2).sum()))
                pairs.append((np.full(len(some), number), some))
        number, some = (np.concatenate(x) for x in zip(*pairs, strict=True))
        score = sequential(own[number], candidates[some])
        order = np.lexsort((least[offered[some]], -score, number))
        first = np.searchsorted(number[order], number[order])
        order = order[np.arange(len(order)) - first < keep]
        some, score, number = offered[some[order]], score[order], number[order]
        return pa.table({"query": pa.array(ids[wanted[number]], pa.int64()), "id": pa.array(ids[some], pa.int64()), "least": pa.array(least[some], pa.int64()), "score": score})

    rows = offered.unionByName(asking).select("curve", "own", "block", "role", "rank", "id", "least", "vector")
    return rows.groupBy("curve", "own", "block").applyInArrow(best, "query long, id long, least long, score double")


def nearest(vectors: DataFrame, every: int = 20, neighbours: int = NEIGHBOURS, curves: int = CURVES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the rows whose vec_id is divisible by ``every``.

    Vectors that are null, zero, hold null or non-finite components, lack an
    id or differ in length from most others take no part.  Equal vectors are
    one class that carries its smallest ids, so copies cost nothing and ties
    go to the smaller id, at every cut.  A row repeated in full is one row; a
    query id with several vectors gets several lists.  If fewer candidates
    exist, all come.  An empty table gives an empty result; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    good = scratch.keep(usable(vectors), "good")
    longest, width = good.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), F.max(F.size("vector"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not width:
        return spark.createDataFrame([], schema)
    longest = float(np.sqrt(longest))
    keep = neighbours + 1  # a query may meet its own id
    by_id = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    ids = good.withColumn("place", by_id).where(F.col("place") <= keep).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = scratch.keep(ids.select(F.monotonically_increasing_id().alias("id"), "vector", "ids"), "classes")
    asked = good.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("id"), F.col("vec_id").alias("query_id"), "vector")
    queries = scratch.keep(asked, "queries")
    sample = sampled(classes.select("vector"), SAMPLE)
    fitted = Curves(_lift(np.array([r.vector for r in sample], np.float64), longest, False), curves, AXES, AXIS_BITS)
    placed = scratch.keep(_order(classes, queries, fitted, longest, scratch), "ranked")
    reach = _reach(placed, classes, queries, keep, recall)

    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    near = _scored(placed, classes, queries, max(reach, LEAST_REACH), keep).distinct().withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)
    near = near.select("query", "id", "score").join(classes.select("id", "ids"), "id").join(queries.select(F.col("id").alias("query"), "query_id"), "query")
    rows = near.select("query", "query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found = rows.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
    found = scratch.keep(found, "found")
    scratch.discard_but("found")
    return found
