"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a unit vector with M projections on Gaussian directions, cut into slots of one width; a
bucket is the M slots. A query visits its own bucket and then perturbed ones in the order of their estimated success:
the probability, with a neighbour's projection normally distributed about the query's, that the neighbour lies in the
bucket. It stops when the visited buckets of a table hold SUCCESS of it. What the tables yield is merged, and the exact
cosine in double precision ranks it.

The width and the spread come from the true neighbours of SAMPLE_QUERIES queries against all rows. Queries that find fewer
than k, or whose k-th lies further away than that spread serves, are compared with all rows in blocks: where most queries
have near copies, the others do not suffer. Equal vectors are one entry with their k + 1 smallest ids. Buckets of over BUCKET_ROWS entries are split into parts, each compared with all
queries that visit the bucket, so nothing is cut off; buckets are dealt into groups, and a group's queries and entries
meet in one product of matrices.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; very
large or small finite components are scaled by a power of two first, so lengths neither overflow nor vanish; only vectors of
one dimension are compared; rows of one vec_id are not each other's neighbours; of repeated rows one counts;
a query with fewer than k candidates found gets those; ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import Work, gather

TABLES = 4
SUCCESS = 0.5
#: Queries whose true neighbours set the width of the slots.
SAMPLE_QUERIES = 64
#: Entries of a bucket, or part of one, that are compared at a time.
BUCKET_ROWS = 4096
#: Entries of a group of buckets.
GROUP_ROWS = 20_000
#: Entries that a bucket has on average.
BUCKET_MEAN = 64
#: Buckets that a query visits on average at most, in all tables; it sets the number of projections, not what is found.
PROBES = 512
#: Times the spread that the k-th neighbour of a query may be away before the query is compared with all rows.
BEYOND = 1.05
#: Queries of a block of such comparisons.
BLOCK_QUERIES = 4000
#: Largest components outside these bounds are scaled.
LEAST, MOST = 2.0**-400, 2.0**400
STEPS = (0, -1, 1, -2, 2)
SEED = 11


def flat(column: pa.Array) -> np.ndarray:
    """A matrix of a column of lists of one length."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part."""
    x = F.transform(vec_col, lambda a: a.cast("double"))
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("v"))
    bad = F.exists("v", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    zero = ~F.exists("v", lambda a: a != 0)
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad & ~zero).withColumn("dim", F.size("v"))
    top = F.array_max(F.transform("v", F.abs))
    half = F.pow(F.lit(2.0), F.floor(-F.log2("top") / 2))  # twice, as the whole factor may overflow
    scaled = F.transform("v", lambda a: a * half * half)
    return v.withColumn("top", top).select("vec_id", F.when(F.col("top").between(LEAST, MOST), F.col("v")).otherwise(scaled).alias("v"), "dim")


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(ids, v, dim): the distinct vectors with their k + 1 smallest ids.

    Each task first keeps the k + 1 smallest ids of a vector among its own rows, so a vector that a large share of the
    rows has comes to the shuffle few times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for i, (vec_id, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                held.setdefault(np.asarray(v.values).tobytes(), []).append((vec_id, i))
            keep = sorted(i for same in held.values() for _, i in sorted(same)[: k + 1])
            yield batch.take(pa.array(keep, pa.int64()))

    some = rows.distinct().mapInArrow(run, rows.schema)
    number = F.row_number().over(Window.partitionBy("v", "dim").orderBy("vec_id"))
    return some.withColumn("n", number).filter(F.col("n") <= k + 1).groupBy("v", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "v", "dim")


def best(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, candidate row and cosine of each query's k best, with all that tie with the k-th."""
    cos = (q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T
    cos[q_ids[:, None] == c_ids] = -9.0
    at = max(0, cos.shape[1] - k)
    least = np.partition(cos, at, axis=1)[:, at]
    row, col = np.nonzero((cos >= least[:, None] - 1e-12) & (cos > -8))
    return row, col, cos[row, col]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, the same for a pair wherever it is computed."""
    return np.clip(np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))), -1.0, 1.0)


def calibrate(found: DataFrame, queries: DataFrame, k: int) -> tuple[float, list[np.ndarray]]:
    """The 80th percentile of unit-vector distances of the k-th true neighbour, of SAMPLE_QUERIES queries against all rows.

    Also the vectors of these queries.
    """
    sample = queries.orderBy(F.xxhash64("vec_id")).limit(SAMPLE_QUERIES).collect()
    if not sample:
        return 1.0, []
    vectors = [np.array(r["v"]) for r in sample]
    dims = {len(r["v"]) for r in sample}
    held = {d: (np.array([r["v"] for r in sample if len(r["v"]) == d]), np.array([r["vec_id"] for r in sample if len(r["v"]) == d])) for d in dims}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = np.asarray(batch.column(2))
            for d, (q, q_ids) in held.items():
                at = np.flatnonzero(dim == d)
                if len(at):
                    some = batch.take(pa.array(at))
                    ids = np.array([x[0] for x in some.column(0).to_pylist()])
                    row, _, cos = best(q, q_ids, flat(some.column(1)), ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(cos)], ["query_id", "cos"])

    near = found.mapInArrow(run, "query_id bigint, cos double").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos")))).filter(F.col("n") == k).select("cos").collect()
    if not near:
        return 1.0, vectors
    return max(0.05, float(np.percentile([sqrt(max(0.0, 2 - 2 * r["cos"])) for r in near], 80))), vectors


def projections_for(n: int, width: float, spread: float, sample: list[np.ndarray]) -> int:
    """As many projections as give buckets of BUCKET_MEAN entries, unless queries then visit over PROBES buckets.

    That many are too many where neighbours are hardly nearer than other rows; fewer, larger buckets hold the same share
    of the neighbours, so the visits of a query do not grow with the table.
    """
    most = int(np.clip(round(np.log(max(n / BUCKET_MEAN, 2)) / np.log(max(2.0, 4.0 / width))), 2, 24))
    for m in range(3, most + 1):
        visits = []
        for v in sample[:8]:
            h = Hashes(len(v), m, width)
            slots, places = h.slots(v[None])
            visits.append(sum(map(len, h.probes(slots[0], places[0], spread))))
        if visits and np.mean(visits) > PROBES:
            return m - 1
    return most


class Hashes:
    """The tables' directions, offsets and slot width for vectors of one dimension."""

    def __init__(self, dim: int, projections: int, width: float):
        rng = np.random.default_rng((SEED, dim))
        self.m, self.width = projections, width
        self.directions = rng.normal(size=(dim, TABLES * projections))
        self.offsets = rng.uniform(0, width, TABLES * projections)
        self.factors = rng.integers(1, 1 << 62, (TABLES, projections), dtype=np.int64) | 1
        self.salt = np.int64(dim) * np.int64(1_000_003)

    def slots(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots and places within them, as rows x tables x projections."""
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        x = ((unit @ self.directions + self.offsets) / self.width).reshape(len(vectors), TABLES, self.m)
        whole = np.floor(x)
        return whole.astype(np.int64), x - whole

    def keys(self, slots: np.ndarray, table: int) -> np.ndarray:
        """A 64-bit name of each bucket."""
        with np.errstate(over="ignore"):
            return (slots * self.factors[table]).sum(axis=-1) ^ (self.salt + table)

    def probes(self, slots: np.ndarray, places: np.ndarray, spread: float) -> list[np.ndarray]:
        """For one query, the buckets to visit in each table, most promising first."""
        out = []
        s = spread / self.width
        for t in range(TABLES):
            options = []  # of each projection: (cost, step), cheapest first
            for f in places[t]:
                p = [0.5 * (erf((1 + d - f) / (s * sqrt(2))) - erf((d - f) / (s * sqrt(2)))) for d in STEPS]
                options.append(sorted((-np.log(max(x, 1e-12)), d) for x, d in zip(p, STEPS)))
            cost = [[c for c, _ in o] for o in options]
            start = sum(c[0] for c in cost)
            heap, held, visited = [(start, (0,) * self.m, 0)], 0.0, []
            while heap and held < SUCCESS:
                total, at, last = heapq.heappop(heap)
                visited.append(at)
                held += np.exp(-total)
                for j in range(last, self.m):
                    k = at[j]
                    if k + 1 < len(STEPS):
                        heapq.heappush(heap, (total + cost[j][k + 1] - cost[j][k], (*at[:j], k + 1, *at[j + 1 :]), j))
            steps = np.array([[o[k][1] for o, k in zip(options, at)] for at in visited], np.int64)
            out.append(self.keys(slots[t] + steps, t))
        return out


def nearest(vectors: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each row that `query` (on vec_id) selects."""
    work = Work(vectors.sparkSession, "ann")
    rows = usable(vectors, id_col, vec_col)
    found = work.save(entries(rows, k), "entries")
    queries = work.save(rows.filter(query).dropDuplicates(["vec_id"]), "queries")
    n = max(1, found.count())
    spread, sample = calibrate(found, queries, k)
    width = 1.25 * spread
    projections = projections_for(n, width, spread, sample)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Hashes] = {}
        for batch in batches:
            for d in np.unique(np.asarray(batch.column(2))).tolist():
                some = batch.filter(pa.array(np.asarray(batch.column(2)) == d))
                h = made.setdefault(d, Hashes(d, projections, width))
                slots, _ = h.slots(flat(some.column(1)))
                keys = np.stack([h.keys(slots[:, t], t) for t in range(TABLES)], axis=1)
                at = pa.array(np.arange(len(some) + 1, dtype=np.int32) * TABLES)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.ListArray.from_arrays(at, pa.array(keys.ravel()))], ["ids", "v", "keys"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Hashes] = {}
        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.asarray(v.values, np.float64)[None]
                h = made.setdefault(x.shape[1], Hashes(x.shape[1], projections, width))
                slots, places = h.slots(x)
                keys = np.unique(np.concatenate(h.probes(slots[0], places[0], spread)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), vec_id, np.int64)), pa.array(keys)], ["query_id", "key"])

    indexed = found.mapInArrow(index, "ids array<bigint>, v array<double>, keys array<bigint>").withColumn("key", F.explode("keys")).drop("keys")
    indexed = indexed.withColumn("h", F.xxhash64("v"))
    size = F.ceil(F.count("*") / F.lit(BUCKET_ROWS)).cast("int")
    buckets = work.save(indexed.groupBy("key").agg(size.alias("parts")), "buckets")
    groups = int(max(12, TABLES * n // GROUP_ROWS + 1))
    group = F.pmod(F.xxhash64("key", "part"), F.lit(groups)).cast("int")
    again = F.xxhash64(F.lit(1), "key")
    placed = indexed.withColumn("k", again).join(buckets.withColumn("k", again), ["k", "key"]).withColumn("part", F.pmod("h", "parts").cast("int")).select(group.alias("g"), "key", "ids", "v")
    probes = queries.repartition(groups, "vec_id").mapInArrow(visits, "query_id bigint, key bigint").join(buckets, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = probes.withColumn("g", group).groupBy("g", "query_id").agg(F.collect_set("key").alias("keys")).join(queries.select(F.col("vec_id").alias("query_id"), "v"), "query_id").select("g", "query_id", "keys", "v")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            dims = np.diff(left["v"].combine_chunks().offsets.to_numpy()), np.diff(right["v"].combine_chunks().offsets.to_numpy())
            for d in np.intersect1d(*dims).tolist():
                out.append(_compare(left.filter(pa.array(dims[0] == d)), right.filter(pa.array(dims[1] == d)), k))
        done = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": done[0], "vec_id": done[1], "score": done[2]})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda rows: rows.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    kind = "query_id bigint, vec_id bigint, score double"
    near = work.save(top(placed.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(compare, kind)), "near")
    work.drop("buckets")
    last = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    served = last.filter((F.col("n") == k) & (F.col("least") >= 1 - (BEYOND * spread) ** 2 / 2))
    far = work.save(queries.join(served.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"), "far")
    blocks = int(far.count() // BLOCK_QUERIES + 1)
    if far.isEmpty():
        return near
    # every block of queries meets every block of entries once, each pair of blocks in a task of its own
    row_blocks, parts = int(max(12, n // GROUP_ROWS + 1)), GROUP_ROWS // BUCKET_ROWS + 1
    q_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    e_block = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("e")
    h = F.xxhash64("v")
    all_rows = found.select(F.pmod(h, F.lit(row_blocks)).cast("int").alias("e"), F.pmod(F.xxhash64(h), F.lit(parts)).alias("key"), "ids", "v", q_block)
    all_asked = far.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b"), F.col("vec_id").alias("query_id"), F.array(*[F.lit(x).cast("bigint") for x in range(parts)]).alias("keys"), "v", e_block)
    more = all_rows.groupBy("e", "b").cogroup(all_asked.groupBy("e", "b")).applyInArrow(compare, kind)
    return top(near.select("query_id", "vec_id", "score").unionAll(more))


def _compare(left: pa.Table, right: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a group for each of its queries, by exact cosine, ties to the smaller id."""
    c, q = flat(left["v"].combine_chunks()), flat(right["v"].combine_chunks())
    ids = left["ids"].combine_chunks()
    key, q_ids = left["key"].to_numpy(), right["query_id"].to_numpy()
    first = np.array([x[0] for x in ids.to_pylist()])
    order = np.argsort(key, kind="stable")
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]])
    names = key[order][bounds[:-1]]
    asked = right["keys"].combine_chunks()
    who = np.repeat(np.arange(len(q_ids)), np.diff(asked.offsets.to_numpy()))
    bucket = np.searchsorted(names, asked.flatten().to_numpy())
    known = (bucket < len(names)) & (names[np.minimum(bucket, len(names) - 1)] == asked.flatten().to_numpy())
    who, bucket = who[known], bucket[known]
    sort = np.argsort(bucket, kind="stable")
    who, bucket = who[sort], bucket[sort]
    row, col = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    for a, b in zip(cut, cut[1:]):
        x = order[bounds[bucket[a]] : bounds[bucket[a] + 1]]
        for m in range(a, b, 512):
            # an entry of the query's own vector has other ids too: it is kept, and the own id goes below
            r, s, _ = best(q[who[m : min(m + 512, b)]], np.full(min(m + 512, b) - m, -(1 << 62)), c[x], first[x], k + 1)
            row.append(who[m : min(m + 512, b)][r])
            col.append(x[s])
    row, col = np.concatenate(row), np.concatenate(col)
    score = exact(q[row], c[col]) if len(row) else np.zeros(0)
    count = np.diff(ids.offsets.to_numpy())[col] if len(col) else np.zeros(0, np.int64)
    at = ids.offsets.to_numpy()[col] if len(col) else np.zeros(0, np.int64)
    vec_id = gather(ids.values.to_numpy(), at, count)
    query_id, score = np.repeat(q_ids[row], count), np.repeat(score, count)
    other = vec_id != query_id
    query_id, vec_id, score = query_id[other], vec_id[other], score[other]
    sort = np.lexsort((vec_id, -score, query_id))
    query_id, vec_id, score = query_id[sort], vec_id[sort], score[sort]
    start = np.searchsorted(query_id, query_id)
    keep = np.arange(len(query_id)) - start < k
    return query_id[keep], vec_id[keep], score[keep]
