"""Approximate nearest neighbours (operator 6): multi-index hashing of learned rotated binary codes.

Codes: vectors are centred, and two learned rotations (alternating sign and Procrustes steps from
different starts, on a bounded sample) give one bit per dimension each. A code is split into 16-bit
substrings, each indexed by its value. A code within Hamming radius r of a query agrees with it up
to floor(r / substrings) bits in at least one substring, so probing all those values returns every
code of the radius; their vectors are reranked in double precision. The radius is that within which
the sample's own true neighbours lie (RECALL of them). Queries and rows meet block by block. Queries
with too few neighbours within the radius are answered again without one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shipshape.llm.common import batches, written

#: Vectors the rotations and the radius are learnt from at most; share of true neighbours the radius takes in.
SAMPLE, RECALL, ROTATIONS, STEPS = 8000, 0.985, 2, 25
#: Rows of an index block and of a query block.
INDEX_ROWS, QUERY_ROWS = 60_000, 1000
SUB = 16


def learn(x: np.ndarray, k: int) -> dict:
    """Mean, rotations and radius from a sample."""
    mean = x.mean(0)
    y, rng, turns = x - mean, np.random.default_rng(7), []
    d = x.shape[1]
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(STEPS):
            u, _, vt = np.linalg.svd(np.where(y @ r > 0, 1.0, -1.0).T @ y)
            r = (u @ vt).T
        turns.append(r)
    model = {"mean": mean, "rotations": np.hstack(turns)}
    codes = encode(model, x)
    ask = np.arange(0, len(x), max(1, len(x) // 400))
    seen = []
    for q in ask:
        near = ((x - x[q]) ** 2).sum(1)
        near[q] = np.inf
        seen.append(bits(codes[np.argsort(near, kind="stable")[:min(k, len(x) - 1)]] ^ codes[q]))
    seen = np.concatenate(seen) if seen else np.zeros(0)
    model["radius"] = int(np.quantile(seen, RECALL)) if len(seen) else model["rotations"].shape[1]
    return model


def encode(model: dict, x: np.ndarray) -> np.ndarray:
    """16-bit substrings of the codes, (rows, substrings)."""
    b = (x - model["mean"]) @ model["rotations"] > 0
    pad = -b.shape[1] % SUB
    b = np.hstack([b, np.zeros((len(b), pad), bool)]).reshape(len(b), -1, SUB)
    return (b * (1 << np.arange(SUB))).sum(2).astype(np.uint16)


def bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def search(ids, x, qids, q, model: dict, k: int, radius: int) -> list[tuple[int, int, float]]:
    """(query, id, distance): the ``k`` nearest rows of a block within the Hamming radius of each query."""
    codes, qcodes = encode(model, x), encode(model, q)
    m, out = codes.shape[1], []
    reach = min(radius // m, SUB)
    tables = []
    for s in range(m):
        order = np.argsort(codes[:, s], kind="stable")
        held, at = np.unique(codes[order, s], return_index=True)
        tables.append((order, held, np.append(at, len(order))))
    for i in range(len(q)):
        if reach >= SUB or radius >= m * SUB:
            found = np.arange(len(x))
        else:
            hit = np.zeros(len(x), bool)
            for s, (order, held, at) in enumerate(tables):
                near = np.bitwise_count(held ^ qcodes[i, s]) <= reach  # the indexed values among all to be probed
                hit[order[np.repeat(near, np.diff(at))]] = True
            found = np.flatnonzero(hit)
            found = found[bits(codes[found] ^ qcodes[i]) <= radius]
        found = found[ids[found] != qids[i]]
        far = np.sqrt(((x[found] - q[i]) ** 2).sum(1))
        best = np.lexsort((ids[found], far))[:k]
        out += [(int(qids[i]), int(ids[found[b]]), float(far[b])) for b in best]
    return out


def _meet(model, k: int, radius: int):
    shared = model

    def run(left, right):
        names, kinds = ["query_id", "vec_id", "score"], (pa.int64(), pa.int64(), pa.float64())
        grid = [np.vstack([np.asarray(r, float) for r in t.column("v").to_pylist()]) if t.num_rows else None for t in (left, right)]
        rows = search(np.asarray(left.column("id")), grid[0], np.asarray(right.column("id")), grid[1], shared.value, k, radius) if left.num_rows and right.num_rows else []
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
    return run


def _round(index: DataFrame, queries: DataFrame, model, k: int, radius: int) -> DataFrame:
    n, q = index.count(), queries.count()
    rows, asks = -(-n // INDEX_ROWS) or 1, -(-q // QUERY_ROWS) or 1
    grid = lambda df, own, others, mine: df.select(F.pmod(F.xxhash64("id", F.lit(own)), F.lit(mine)).alias(own), F.explode(F.expr(f"sequence(0L, {others - 1}L)")).alias("other"), "id", "v")
    left = grid(index, "row_block", asks, rows).select("row_block", F.col("other").alias("ask_block"), "id", "v")
    right = grid(queries, "ask_block", rows, asks).select(F.col("other").alias("row_block"), "ask_block", "id", "v")
    found = left.groupBy("row_block", "ask_block").cogroup(right.groupBy("row_block", "ask_block")).applyInArrow(_meet(model, k, radius), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")  # at most k rows of each row block
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbours(rows: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose id is divisible by ``every``.

    Null ids and vectors that are null, zero, empty or hold null or non-finite components take no
    part, nor do those of another than the most frequent dimension (of equally frequent ones the
    larger). Rows that repeat an id count once (the greatest vector). Ties go to the smaller id.
    """
    spark = rows.sparkSession
    batches(spark)
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull()).where(
        F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))).where(F.exists("v", lambda c: c != 0))
    own = written(own.groupBy("id").agg(F.max("v").alias("v")))
    shape = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = own.where(F.size("v") == shape["d"])
    drawn = written(own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE))  # collected at once, every partition would send its own SAMPLE rows to the driver
    drawn = np.array([r["v"] for r in drawn.collect()])
    model = learn(drawn, k)
    shared = spark.sparkContext.broadcast(model)
    queries = own.where(F.col("id") % every == 0)
    first = written(_round(own, queries, shared, k, model["radius"]))
    full = min(k, own.count() - 1)
    done = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= full).select("query_id")
    rest = written(queries.join(done, F.col("id") == F.col("query_id"), "left_anti"))
    if not rest.isEmpty():
        again = _round(own, rest, shared, k, 1 << 20)
        first = first.join(rest.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*first.columns).union(again.select(*first.columns))
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
