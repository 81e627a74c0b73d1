r"""Exact k-means of integer vectors by Shallot search.

Vectors and centroids are integers, so squared distances are exact. Each vector
carries its nearest and second-nearest centroid, an upper bound of the distance
to the first and a lower bound of the distance to every other one. A round
widens the bounds by how far centroids moved and looks at a vector only where
they overlap:

1. the distance to its own centroid is made exact, which may settle it;
2. else the distance to the remembered second one is taken too, and the search
   starts from the closer of both;
3. the other centroids come in order of their distance from the start. The
   search ends at the first one outside the ball whose radius is the distance to
   the start plus that to the second-nearest found so far; each nearer centroid
   shrinks the ball. Survivors are compared as integers.

Bounds are floating and always rounded outwards, so they only ever spare a
comparison whose outcome is certain; ties go to the smaller centroid number.

Vectors stay in the tasks. A round is one pass that writes the state as Parquet
in the shared folder and one aggregate with a row per task and centroid; the
driver holds centroids and their sums only, so work is even whatever vectors
repeat, and a lost executor repeats its part of one round.

Defined results: rows whose vector is null, of another length, or has a null, NaN
or infinite component are left out; a null key keeps its row but its vector
isn't a start; repeated rows count and are starts as often as they occur, later ones being empty
clusters; fewer vectors than clusters give as many clusters as vectors; an empty
table, or one without any key, gives no rows. A component beyond 2^27 after scaling is an error, since
squared distances would leave a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from foretrace.session import fresh_path, ship_by_value

ship_by_value(__name__)

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
SEED = "1"
# Squared distances of components up to this size fit a long.
LARGEST = 1 << 27
# Vectors compared at once.
BLOCK = 4096
# Relative slack of a bound, larger than the rounding of the operations that make it.
SLACK = 2.0 ** -50


def up(x):
    """A number at least as large as what x was computed for."""
    return x * (1 + SLACK)


def down(x):
    return x * (1 - SLACK)


class Shallot:
    """Centroids of a round, with all that bounds and search need of them."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        k = len(centroids)
        apart = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
        ranked = np.argsort(np.where(np.eye(k, dtype=bool), -1, apart), axis=1, kind="stable")[:, 1:]
        self.order = ranked
        self.gap = down(np.sqrt(np.take_along_axis(apart, ranked, 1).astype(float)))
        self.half = down(self.gap[:, 0] / 2) if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else up(np.sqrt(((centroids - before) ** 2).sum(1).astype(float)))
        # How far any centroid but this one moved.
        self.others = np.array([np.delete(self.moved, i).max(initial=0.0) for i in range(k)])

    def squared(self, vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        """Exact squared distances of vectors to one centroid each."""
        out = np.empty(len(vectors), np.int64)
        for at in range(0, len(vectors), BLOCK):
            apart = vectors[at:at + BLOCK] - self.centroids[centroid[at:at + BLOCK]]
            out[at:at + BLOCK] = np.einsum("ij,ij->i", apart, apart)
        return out

    def assign(self, vectors, first, second, upper, lower):
        """Nearest and second-nearest centroids and their bounds after this round's moves."""
        first, second = first.copy(), second.copy()
        upper, lower = up(upper + self.moved[first]), down(np.maximum(lower - self.others[first], 0))
        enough = np.maximum(lower, self.half[first])
        unsure = np.flatnonzero(~(upper < enough))
        exact = self.squared(vectors[unsure], first[unsure])
        upper[unsure] = up(np.sqrt(exact.astype(float)))
        left = ~(upper[unsure] < enough[unsure])
        unsure, exact = unsure[left], exact[left]
        if len(unsure):
            found = self.search(vectors[unsure], first[unsure], exact, second[unsure])
            first[unsure], second[unsure], upper[unsure], lower[unsure] = found
        return first, second, upper, lower

    def search(self, vectors, first, first_squared, second):
        """Exact nearest and second-nearest centroids of vectors that bounds can't settle."""
        second_squared = self.squared(vectors, second)
        swap = (second_squared < first_squared) | ((second_squared == first_squared) & (second < first))
        start, other = np.where(swap, second, first), np.where(swap, first, second)
        best, best_squared = start.copy(), np.minimum(first_squared, second_squared)
        next_, next_squared = other.copy(), np.maximum(first_squared, second_squared)
        from_start = up(np.sqrt(best_squared.astype(float)))
        active = np.arange(len(vectors))
        for rank in range(self.order.shape[1]):
            ball = up(from_start[active] + up(np.sqrt(next_squared[active].astype(float))))
            active = active[self.gap[start[active], rank] <= ball]
            if not len(active):
                break
            candidate = self.order[start[active], rank]
            fresh = candidate != other[active]
            rows, candidate = active[fresh], candidate[fresh]
            squared = self.squared(vectors[rows], candidate)
            nearer = (squared < best_squared[rows]) | ((squared == best_squared[rows]) & (candidate < best[rows]))
            between = ~nearer & (squared < next_squared[rows])
            won, lost = rows[nearer], rows[between]
            next_[won], next_squared[won] = best[won], best_squared[won]
            best[won], best_squared[won] = candidate[nearer], squared[nearer]
            next_[lost], next_squared[lost] = candidate[between], squared[between]
        return best, next_, up(np.sqrt(best_squared.astype(float))), down(np.sqrt(next_squared.astype(float)))


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(key, q) of the usable vectors, q being floor(scale * component)."""
    x = F.col(f"`{vector}`")
    usable = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def whole(v):
        number = F.floor(v.cast("double") * scale)
        return F.when(F.abs(number) <= LARGEST, number).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("long")).cast("int")

    return vectors.where(usable).select(F.col(f"`{key}`").alias("key"), F.transform(x, whole).alias("q"))


def starts(rows: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors of the smallest hashes of their keys, in that order; at most ``clusters`` rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    chosen = rows.where(F.col("key").isNotNull()).select("q", digest.alias("h")).orderBy("h", "q").limit(clusters).collect()
    return np.array([r["q"] for r in chosen], np.int64)


def assign(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The state after one assignment, with the squared distance to the nearest centroid."""
    shared = state.sparkSession.sparkContext.broadcast((centroids, before))
    schema = StructType([state.schema["key"], StructField("q", ArrayType(IntegerType())), StructField("first", IntegerType()),
                         StructField("second", IntegerType()), StructField("upper", DoubleType()), StructField("lower", DoubleType()), StructField("squared", LongType())])

    def run(batches):
        search = Shallot(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
            carried = [batch.column(i).to_numpy() for i in range(2, 6)]
            first, second, upper, lower = search.assign(q, *carried)
            made = [pa.array(x.astype(np.int32)) for x in (first, second)] + [pa.array(x) for x in (upper, lower, search.squared(q, first))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=schema.names)

    return state.select("key", "q", "first", "second", "upper", "lower").mapInArrow(run, schema)


def written(state: DataFrame) -> DataFrame:
    """The state as a table in the shared folder: lineage ends here, small numbers are stored in few bits."""
    path = fresh_path(state.sparkSession, "centroids")
    state.write.parquet(path)
    return state.sparkSession.read.parquet(path)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floors of the means; a cluster without vectors keeps its centroid."""
    sums = [F.sum(F.get("q", F.lit(i)).cast("long")).alias(f"c{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in state.groupBy("first").agg(F.count("*").alias("n"), *sums).collect():
        out[r["first"]] = [r[f"c{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every usable vector after ``rounds`` rounds, and the final centroids."""
    rows = quantised(vectors, key, vector, dimensions, scale)
    centroids, before = starts(rows, clusters, seed), None
    if not len(centroids):
        return rows.where("false").select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    state = rows.withColumns({
        "first": F.lit(0), "second": F.lit(min(1, len(centroids) - 1)), "upper": F.lit(float("inf")), "lower": F.lit(0.0)})
    for _ in range(rounds):
        state = written(assign(state, centroids, before))
        before, centroids = centroids, means(state, centroids)
    state = written(assign(state, centroids, before))
    return state.select(F.col("key").alias(key), F.col("first").alias("cluster"), F.col("squared").alias("distance")), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the inertia of each cluster and of all, and a digest of its final centroid.

    The sums have one row a cluster; that table is broadcast.
    """
    spark = assigned.sparkSession
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster")
