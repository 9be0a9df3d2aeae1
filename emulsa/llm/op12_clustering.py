"""Centroid clustering of vectors in exact integers, with block-norm screening.

A vector's components become floor(64 x).  Its segments of ``SEGMENT`` components have norms, computed once
and kept with the vector; by Cauchy-Schwarz the squared differences of two vectors' segment norms add up
to no more than their squared distance.  A round compares these norms first: the centroid with the least
bound gets an exact distance, then only those whose bound doesn't exceed the best distance so far.  Bounds are
lowered by a margin over their rounding error, so no nearest centroid is screened out.  ``exact_distances``
says how many a vector needed.

New centroids come from sums that Spark adds up: each task sends a row for each cluster, and sums are kept in
limbs of 32 bits, so that no component overflows.  The driver sees k rows a limb.

Kept are vectors with exactly ``DIM`` components, none null or non-finite; all others, and null vectors, have
no row.  Ties of the starting hash (repeated ids; a null id counts as the empty text) go by the components.  Fewer vectors
than k give fewer centroids; an empty table gives an empty result.  Repeated rows are rows of their own.
Components of more than 2**27 are computed in unbounded integers; a distance or inertia that no long can
hold is null.  Only id and vector are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.llm.common import cut

DIM, SEGMENT, K, ROUNDS, SCALE = 64, 8, 16, 3, 64
#: Integers up to this size have distances that a long holds.
SMALL = 1 << 27
LONG = 1 << 63


def integers(values: np.ndarray) -> np.ndarray:
    """floor(64 x), as int64 where all are small, else as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not len(scaled) or np.abs(scaled).max() <= SMALL:
        return scaled.astype(np.int64)
    whole = lambda x: int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)
    return np.array([[whole(x) for x in row] for row in values.tolist()], dtype=object).reshape(values.shape)


def segment_norms(x: np.ndarray) -> np.ndarray:
    parts = x.reshape(len(x), -1, SEGMENT)
    return np.sqrt((parts.astype(float) ** 2).sum(2))


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, the vector's doubles and its segment norms, packed; vectors that don't qualify go."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(col), DIM), False))
            flat = batch.column(1).flatten()
            x = pc.fill_null(flat.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False).reshape(-1, DIM)
            good = np.isfinite(x).all(1)
            x = np.ascontiguousarray(x[good])
            with np.errstate(over="ignore"):
                norms = segment_norms(np.floor(x * SCALE))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in norms], pa.binary())], names=["vec_id", "x", "norms"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(pack, "vec_id long, x binary, norms binary")


def doubles(col, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), float).reshape(-1, width)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, exact distances computed) of each vector; ties go to the smaller number."""
    wide = x.dtype == object or any(abs(v) > SMALL for c in centroids for v in c)
    c = np.array(centroids, dtype=object if wide else np.int64)
    if wide:  # no bound that doubles could hold
        x, bound = x.astype(object), np.full((len(x), len(c)), -np.inf)
    else:
        c_norms = segment_norms(c)
        size = (norms**2).sum(1)[:, None] + (c_norms**2).sum(1)[None, :]
        bound = size - 2 * norms @ c_norms.T - 1e-9 * size - 1
    cluster = bound.argmin(1)
    best = ((x - c[cluster]) ** 2).sum(1)
    tried = np.ones(len(x), np.int64)
    first = cluster.copy()
    for k in range(len(c)):
        at = np.flatnonzero((bound[:, k] <= best).astype(bool) & (first != k))
        d = ((x[at] - c[k]) ** 2).sum(1)
        better = (d < best[at]) | ((d == best[at]) & (k < cluster[at]))
        cluster[at[better]], best[at[better]] = k, d[better]
        tried[at] += 1
    return cluster, best, tried


def limbs(v: np.ndarray) -> list[np.ndarray]:
    """Little-endian 32-bit limbs, the last one signed."""
    out = []
    while True:
        if v.dtype != object or all(-LONG // 4 < a < LONG // 4 for a in v):
            return [*out, v.astype(np.int64)]
        out.append((v & 0xFFFFFFFF).astype(np.int64))
        v = v >> 32


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, d, tried = nearest(integers(doubles(batch.column(1), DIM)), doubles(batch.column(2), DIM // SEGMENT), centroids)
                d = pa.array([int(v) if v < LONG else None for v in d.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), d, pa.array(tried, pa.int32())], names=["vec_id", "cluster", "distance", "exact_distances"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long, exact_distances int")


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The clusters' exact floored means; a cluster without vectors keeps its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(doubles(batch.column(1), DIM))
            cluster, _, _ = nearest(x, doubles(batch.column(2), DIM // SEGMENT), centroids)
            out: dict[str, list] = {"cluster": [], "limb": [], "n": [], "sums": []}
            for k in np.unique(cluster):
                mine = x[cluster == k]
                for j, part in enumerate(limbs(mine.sum(0))):
                    for name, v in zip(out, (int(k), j, len(mine) if not j else 0, part.tolist()), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("cluster", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    parts = rows.mapInArrow(run, "cluster int, limb int, n long, sums array<bigint>")
    sums = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIM)]
    total = {k: [0] * DIM for k in range(len(centroids))}
    count = dict.fromkeys(total, 0)
    for r in parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *sums).collect():  # a row for each cluster and limb
        count[r.cluster] += r.n
        for i in range(DIM):
            total[r.cluster][i] += int(r[f"s{i}"]) << (32 * r.limb)
    return [[s // count[k] for s in total[k]] if count[k] else old for k, old in enumerate(centroids)]


def start(rows: DataFrame, k: int = K) -> list[list[int]]:
    """The integers of the k vectors whose ids have the smallest hashes."""
    hashed = rows.select(F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("hash"), "x")
    first = hashed.orderBy("hash", "x").limit(k).collect()
    return [[int(v) for v in row] for row in integers(np.array([np.frombuffer(r.x, float) for r in first]).reshape(-1, DIM))]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and exact_distances of every kept vector."""
    spark = vectors.sparkSession
    rows = cut(prepared(vectors))
    centroids = start(rows, k)
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids)
    found = cut(assigned(rows, centroids))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count(F.when(F.col("distance").isNull(), 1)).alias("beyond")).collect()  # at most k rows
    held = lambda beyond, s: None if beyond or s >= LONG else int(s)
    whole = held(sum(r.beyond for r in sums), sum(r.s or 0 for r in sums))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(r.cluster, held(r.beyond, r.s or 0), whole, digest[r.cluster]) for r in sums], "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(about), F.col("cluster") == F.col("of"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "exact_distances")


def oracle(k: int = K, rounds: int = ROUNDS) -> str:
    """The same by all distances, for vectors of ordinary size; without ``exact_distances``."""
    nearest_of = lambda c: f"""
      select id, v, cluster, distance from (
        select x.id, x.v, c.cluster, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance,
               row_number() over (partition by x.id order by list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.cluster) as place
        from x cross join {c} c) where place = 1"""  # noqa: E731
    steps = []
    for r in range(rounds):
        steps.append(f"""a{r} as ({nearest_of(f"c{r}")}),
        u{r} as (select cluster, i, sum(v[i])::bigint as s, count(*) as n from a{r}, range(1, {DIM + 1}) t(i) group by cluster, i),
        m{r} as (select cluster, list((s - ((s % n) + n) % n) // n order by i) as v from u{r} group by cluster),
        c{r + 1} as (select c.cluster, coalesce(m.v, c.v) as v from c{r} c left join m{r} m on c.cluster = m.cluster)""")
    return f"""
with kept as (
  select vec_id, embedding from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {DIM}),
x as (select row_number() over () as id, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::double)::bigint) as v from kept),
c0 as (select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, ''))) - 1 as cluster, v from x
       qualify cluster < {k}),
{", ".join(steps)},
a as ({nearest_of(f"c{rounds}")})
select x.vec_id, a.cluster::int as cluster, a.distance, (sum(a.distance) over (partition by a.cluster))::bigint as cluster_inertia,
       (sum(a.distance) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a join x on a.id = x.id join c{rounds} c on a.cluster = c.cluster"""
