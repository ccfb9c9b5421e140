"""Embedding near-duplicates: Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised in double precision.  Each of L tables hashes a vector by
K quantised random projections floor((a.x + b) / WIDTH); vectors that share a
bucket are compared exactly.  A pair that meets in several tables counts in the
first one only, which its K * L hash values show, so link counts are summed from
buckets, and no pair is ever listed; components need a star per bucket.
Equal vectors are one class from the start, and a bucket of more than BLOCK
classes is compared block by block in separate tasks.

Buckets travel without vectors: a row is an id and a sketch of SKETCH projection
signs.  Only members with a companion whose sketch is near enough for the cosine
fetch their vectors, so chance companions cost no vector.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, released, written

COSINE = 0.95
WIDTH = 2.0
RECALL = 0.995  # of pairs at the threshold; closer pairs are found more surely
FAR = 512  # expected chance companions of a vector in a bucket
BLOCK = 4096
STEP = 512  # vectors of a block compared at a time
SKETCH = 128
SEED = 20240101


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two points at this distance into the same cell."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(K, L): K grows with log n so that buckets stay small, L keeps the recall."""
    far, near = collision(math.sqrt(2)), collision(math.sqrt(max(1e-9, 2 - 2 * cosine)))
    k = max(4, math.ceil(math.log(max(1.0, n / FAR)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k)))


def _unit(vectors: list) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _projection(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.normal(size=(dim, k * tables)), rng.uniform(0, WIDTH, k * tables)


def _keys(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The hash of each unit vector in each table."""
    a, c = _projection(x.shape[1], k, tables)
    cells = np.floor((x @ a + c) / WIDTH).astype(np.int64).reshape(len(x), tables, k)
    weights = np.random.default_rng(SEED + 1).integers(1, 1 << 62, k) * 2 + 1
    return (cells * weights).sum(2) + x.shape[1]


def sketches(x: np.ndarray) -> np.ndarray:
    """SKETCH signs of random projections of each vector, as two 64-bit words."""
    a = np.random.default_rng([SEED + 2, x.shape[1]]).normal(size=(x.shape[1], SKETCH))
    return np.packbits(x @ a > 0, axis=1).view(np.int64)


def sketch_limit(cosine: float) -> int:
    """Differing signs that a pair at the cosine exceeds with a chance of less than 10^-7."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(SKETCH * p + 5.5 * math.sqrt(SKETCH * p * (1 - p)) + 1)


def _bucket_rows(classes: DataFrame, k: int, tables: int) -> DataFrame:
    """(bucket, at, rep, s0, s1): one row per class and table."""
    names = ["bucket", "at", "rep", "s0", "s1"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps, vectors = b.column(0).to_numpy(), b.column(1)
            sizes = np.asarray([len(v) for v in vectors])
            for dim in np.unique(sizes):
                pick = np.flatnonzero(sizes == dim)
                x = _unit(vectors.take(pa.array(pick)).to_pylist())
                keys, signs = _keys(x, k, tables), sketches(x)
                for t in range(tables):
                    bucket = keys[:, t] * np.int64(0x5851F42D4C957F2D) + np.int64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 62))
                    cols = (bucket, np.full(len(pick), t, np.int32), reps[pick], signs[:, 0], signs[:, 1])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return classes.select("rep", "embedding").mapInArrow(run, "bucket long, at int, rep long, s0 long, s1 long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (bucket, bi, bj), the first three columns, by which the rows are sorted."""
    now, held = None, []
    for b in batches:
        key = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for s, e in itertools.pairwise(cuts):
            this = tuple(key[s].tolist()) if s < e else now
            if this != now and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = this
            if s < e:
                held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a group are compared with which: all with all in one block, else one block with the other."""
    side, bi, bj = (group.column(c).to_numpy() for c in ("side", "bi", "bj"))
    return np.flatnonzero(side == bi), np.flatnonzero(side == bj)


def _near(rows: DataFrame, limit: int) -> DataFrame:
    """The rows of ``rows`` with a companion in their bucket and blocks whose sketch differs in no more than ``limit`` signs."""
    names = ["bucket", "bi", "bj", "side", "at", "rep"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            a, b = _sides(group)
            words = [group.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")]
            met = np.zeros(group.num_rows, bool)
            same = len(a) == group.num_rows
            for s in range(0, len(a), STEP):
                part = a[s : s + STEP]
                apart = sum(np.bitwise_count(w[part][:, None] ^ w[b][None, :]) for w in words)
                if same:
                    apart[np.arange(len(part)), np.arange(s, s + len(part))] = 255
                close = apart <= limit
                met[part] |= close.any(1)
                met[b] |= close.any(0)
            if met.any():
                yield group.select(names).filter(pa.array(met)).combine_chunks().to_batches()[0]

    return rows.select("bucket", "bi", "bj", "side", "at", "rep", "s0", "s1").mapInArrow(run, "bucket long, bi int, bj int, side int, at int, rep long")


def _compare(x: np.ndarray, y: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks that reach the cosine."""
    found = []
    for s in range(0, len(x), STEP):
        i, j = np.nonzero(x[s : s + STEP] @ y.T >= cosine)
        i += s
        found.append((i[i < j], j[i < j]) if same else (i, j))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    return i, j


def _fresh(i: np.ndarray, j: np.ndarray, x: np.ndarray, at: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no earlier table has seen."""
    if not at or not len(i):
        return i, j
    linked, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    keys = _keys(x[linked], k, tables)[:, :at]
    p, q = place[: len(i)], place[len(i) :]
    new = np.ones(len(i), bool)
    for s in range(0, len(i), 100_000):
        new[s : s + 100_000] = ~(keys[p[s : s + 100_000]] == keys[q[s : s + 100_000]]).any(1)
    return i[new], j[new]


def _local_stars(nodes: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node reachable within the block, by repeated minima over the pairs."""
    root = np.arange(nodes)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _bucket_links(rows: DataFrame, cosine: float, k: int, tables: int) -> DataFrame:
    """(rep, links, root) of the classes that link within a bucket; rows are bucket, bi, bj, side, at, rep, mult, embedding."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            group = group.sort_by("rep")
            rep, mult = group.column("rep").to_numpy(), group.column("mult").to_numpy()
            x = _unit(group.column("embedding").to_pylist())
            a, b = _sides(group)
            if not (len(a) and len(b)):
                continue
            i, j = _compare(x[a], x[b], len(a) == len(x), cosine)
            i, j = _fresh(a[i], b[j], x, group.column("at")[0].as_py(), k, tables)
            if not len(i):
                continue
            links = np.bincount(i, mult[j], len(x)) + np.bincount(j, mult[i], len(x))
            root = rep[_local_stars(len(x), i, j)]
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], names=["rep", "links", "root"])

    return rows.select("bucket", "bi", "bj", "side", "at", "rep", "mult", "embedding").mapInArrow(run, "rep long, links long, root long")


def cosine_components(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row of ``vectors`` (vec_id, embedding).

    Null and zero vectors and vectors with null or non-finite components link with
    nothing, nor do vectors of different lengths or a null vec_id.  Repeated rows
    are other vectors and count as links.  Other columns are ignored.
    """
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    base = vectors.select("vec_id", e.cast("array<double>").alias("embedding")).select("vec_id", "embedding", (F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()).alias("fine"))
    keyed = base.withColumn("h", F.when(F.col("fine"), F.xxhash64("embedding"))).withColumn("g", F.when(F.col("fine"), F.xxhash64(F.lit(1), "embedding")))
    classes = written(keyed.where("fine").groupBy("h", "g", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")), "vector-classes")
    n = classes.count()
    k, tables = plan(n, cosine)
    rows = written(_bucket_rows(classes, k, tables), "vector-buckets")
    big = written(rows.groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select(F.col("bucket").alias("hot"), F.ceil(F.col("c") / BLOCK).cast("int").alias("s")), "vector-hot")
    dealt = rows.join(big, rows.bucket == big.hot, "left").withColumn("s", F.coalesce("s", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("s")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = dealt.withColumn("bi", F.least("side", "o")).withColumn("bj", F.greatest("side", "o"))
    place = ["bucket", "bi", "bj"]
    sorted_by_place = lambda df: df.repartition(*place).sortWithinPartitions(*place)
    near = written(_near(sorted_by_place(dealt), sketch_limit(cosine)), "vector-near")
    fetched = near.join(classes.select("rep", "mult", "embedding"), "rep")
    found = written(_bucket_links(sorted_by_place(fetched), cosine, k, tables), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts_of = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = classes.select("h", "g", "rep", "mult").join(links, "rep", "left").join(parts_of, F.col("rep") == F.col("node"), "left")
    known = written(known.select("h", "g", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c")), "vector-known")
    out = keyed.select("vec_id", "h", "g").join(known, ["h", "g"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def oracle_sql(cosine: float = COSINE) -> str:
    """The same rows of ``embeddings`` in DuckDB's SQL, over all pairs: for small tables with unique vec_ids."""
    return f"""
WITH RECURSIVE
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {cosine}),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
low AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(low.other, v.vec_id)) AS component_id, v.vec_id <= coalesce(low.other, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.vec_id = v.vec_id LEFT JOIN low ON low.vec_id = v.vec_id"""
