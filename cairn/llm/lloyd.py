"""Centroid clustering with the dimensions dealt out: each task holds a block of columns and the same slice of the centroids."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

DIMENSIONS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024.0
#: Components of a column block, and vectors of a chunk: a block of a chunk is one record.
BLOCK, CHUNK = 32, 2048
#: Below this, squared distances of 2**10 components fit 64 bits; beyond, whole numbers of any size are used.
SMALL = 1 << 26
MOST = (1 << 63) - 1


def _stored(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers given as doubles, in the narrowest type that holds them all."""
    top = np.abs(x).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind, np.ascontiguousarray(x.astype(kind)).tobytes()


def _whole(x: np.ndarray) -> np.ndarray:
    """As 64-bit numbers where these are small enough for exact sums, else as Python's."""
    if np.abs(x).max(initial=0) < SMALL:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def _slice(centroids: list[list[int]], block: int) -> np.ndarray:
    part = [c[block * BLOCK : (block + 1) * BLOCK] for c in centroids]
    fits = all(abs(v) < SMALL for c in part for v in c)
    return np.array(part, dtype=np.int64 if fits else object)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if x.dtype != object and x.max(initial=0) < 1 << 31 else x


def partial_distances(x: np.ndarray, part: np.ndarray) -> np.ndarray:
    """(vector, centroid): squared distances over the components of one block."""
    return _narrow(np.stack([((x - c) ** 2).sum(axis=1) for c in part], axis=1))


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    wide = [v if v.dtype == object else v.astype(np.int64) for v in (a, b)]
    return _narrow(wide[0] + wide[1])


def _nearest(total: np.ndarray) -> tuple[bytes, list[int]]:
    """The nearest centroid of each vector (of equally near ones that of the smallest number), and its distance."""
    best = np.array([min(range(len(r)), key=r.__getitem__) for r in total]) if total.dtype == object else total.argmin(axis=1)
    return best.astype("<i4").tobytes(), [int(v) for v in total[np.arange(len(total)), best]]


def _slice_sums(x: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """(centroid, component): sums of a block's components over the vectors of each centroid, and their number in a last column."""
    out = np.zeros((k, x.shape[1] + 1), dtype=object)
    for c in np.unique(labels):
        mine = x[labels == c]
        out[c, :-1], out[c, -1] = [int(v) for v in mine.sum(axis=0)], len(mine)
    return out


def _chunks(batches, dimensions: int):
    """Arrow batches (id, embedding) -> rows (ids, kind, data) of at most CHUNK vectors."""
    held, ids, n = [], [], 0

    def put():
        kind, data = _stored(np.floor(np.concatenate(held) * SCALE))
        return pa.RecordBatch.from_pydict({"ids": pa.array([ids], pa.list_(pa.int64())), "kind": [kind], "data": pa.array([data], pa.binary())})

    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK // 4):
            part = batch.slice(at, CHUNK // 4)
            held.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions))
            ids += part.column(0).to_pylist()
            n += part.num_rows
            if n >= CHUNK:
                yield put()
                held, ids, n = [], [], 0
    if n:
        yield put()


def _expanded(batches):
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(np.frombuffer(r["labels"], "<i4"), pa.int32()), pa.array(r["distances"], pa.int64())], ["id", "cluster", "distance"])


def lloyd(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """A row per usable vector: id, cluster, distance (squared, to its centroid), cluster_inertia, inertia and centroid_sha256.

    Usable are vectors of `dimensions` components, none null or non-finite; the others have no row. Components become
    floor(1024 * x), and all that follows is exact in whole numbers (distances and sums beyond 64 bits are given as the greatest
    long). Rows are counted as they come, so repeated ids or vectors have a row each. The first centroids are the vectors of least
    sha256("<seed>:<id>"), of like ids those of least components; rows with a null id are clustered, but never begin a centroid, unless
    there are only such. Fewer vectors than k give so many centroids; an empty table no rows. Other columns are not read.

    Vectors lie in chunks, chunks in column blocks. In each round a task of a block adds its columns' squared differences from its slice
    of the centroids; these are summed by chunk (reduceByKey), whose argmin goes back to the chunk's blocks, and each block updates its
    slice. Blocks are dealt out once; only k sums a component reach the driver.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    good = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.coalesce(good, F.lit(False)))
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "x").limit(k).collect()
    centroids = [[math.floor(v * SCALE) for v in r.x] for r in first]
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    stored = written(kept.mapInArrow(lambda batches: _chunks(batches, dimensions), "ids array<long>, kind string, data binary"), "chunks")
    chunks = stored.rdd.zipWithIndex()
    blocks = math.ceil(dimensions / BLOCK)
    # partition p holds blocks p % blocks only: keys are whole numbers, which are their own hash
    parts = blocks * math.ceil(max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored.rdd.getNumPartitions()) / blocks)

    def split(item):
        row, at = item
        data = np.frombuffer(bytes(row.data), row.kind).reshape(-1, dimensions)
        for b in range(blocks):
            part = np.ascontiguousarray(data[:, b * BLOCK : (b + 1) * BLOCK])
            yield at * blocks + b, (row.kind, part.shape, part.tobytes())

    def load(v):
        return _whole(np.frombuffer(v[2], v[0]).reshape(v[1]))

    dealt = chunks.flatMap(split).partitionBy(parts)

    def assigned(now):
        near = lambda item: (item[0] // blocks, partial_distances(load(item[1]), _slice(now, item[0] % blocks)))
        return dealt.map(near).reduceByKey(_add, parts).mapValues(_nearest)

    def updated(now, labels):
        back = labels.flatMap(lambda item: [(item[0] * blocks + b, item[1][0]) for b in range(blocks)]).partitionBy(parts)

        def sums(item):
            key, (block, mine) = item
            return key % blocks, _slice_sums(load(block), np.frombuffer(mine, "<i4"), k)

        shards = dealt.join(back, parts).map(sums).reduceByKey(lambda a, b: a + b, blocks)
        new = shards.mapValues(lambda s: [[int(v) // int(r[-1]) for v in r[:-1]] if r[-1] else None for r in s]).collectAsMap()
        return [[v for b in range(blocks) for v in new[b][c]] if new[0][c] is not None else now[c] for c in range(k)]

    for _ in range(rounds):
        last, centroids = centroids, updated(centroids, assigned(centroids))
        if centroids == last:
            break  # further rounds change nothing
    names = chunks.map(lambda item: (item[1], item[0].ids))
    final = names.join(assigned(centroids), parts).map(lambda item: (item[1][0], bytearray(item[1][1][0]), [min(d, MOST) for d in item[1][1][1]]))
    labelled = written(spark.createDataFrame(final, "ids array<long>, labels binary, distances array<long>"), "labelled")
    rows = labelled.mapInArrow(_expanded, "id long, cluster int, distance long")
    inertia = {r[0]: min(int(r[1]), MOST) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    total = min(sum(inertia.values()), MOST)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(c, inertia.get(c, 0), total, digest[c]) for c in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Lloyd's rounds one after another, in whole numbers."""
    floor = "CAST(divide(s - (((s % n) + n) % n), n) AS BIGINT)"
    near = "SELECT vec_id, e, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.e, k.c, CAST(list_sum(list_transform(list_zip(v.e, k.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i} k) GROUP BY vec_id, e"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS c, e FROM v QUALIFY c < {CLUSTERS})",
    ]
    for i in range(ROUNDS):
        mean = f"SELECT c, list({floor} ORDER BY place) AS e FROM (SELECT c, place, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, unnest(range({DIMENSIONS})) AS place FROM a{i}) GROUP BY c, place) GROUP BY c"
        steps += [f"a{i} AS MATERIALIZED ({near.format(i=i)})", f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.e, o.e) AS e FROM c{i} o LEFT JOIN ({mean}) m ON o.c = m.c)"]
    steps += [f"a AS MATERIALIZED ({near.format(i=ROUNDS)})"]
    return f"WITH {', '.join(steps)} SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.e, ',')) AS centroid_sha256 FROM a JOIN c{ROUNDS} k ON a.c = k.c"


OP11_SQL = _oracle()


def op11_dimension_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd(table(spark, sf_dir, "embeddings"))
