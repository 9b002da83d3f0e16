"""Exact top-k by inner product: a dual-tree search over cover trees, spread over blocks.

Candidates are dealt into cells around sampled pivots, large cells into blocks of bounded size. A
query goes to a cell only if the cell's bound can reach its k-th score among the pivots. Within a
block the queries and the candidates each get a cover tree, and pairs of nodes are dropped whose
covering radii leave no way to the worst k-th score of the query node.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows of a block at most (on average), queries of a group, sampled pivots.
BLOCK_ROWS = 20_000
GROUP_ROWS = 4_000
MOST_PIVOTS = 128
LEAF = 64


class Node:
    """A ball of a cover tree: rows of the matrix, its centre, the covering radius and the balls inside."""

    __slots__ = ("rows", "centre", "norm", "radius", "children")

    def __init__(self, rows, centre, radius):
        self.rows, self.centre, self.radius, self.children = rows, centre, radius, []
        self.norm = float(np.sqrt(centre @ centre))


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """Cover tree of the rows of x: the balls of a node cover its rows at half its radius or less.

    Centres are taken farthest first; equal rows end in one leaf.
    """

    def ball(rows, centre):
        d = x[rows] - centre
        return Node(rows, centre, float(np.sqrt(max(0.0, np.einsum("ij,ij->i", d, d).max()))))

    root = ball(np.arange(len(x)), x.mean(axis=0))
    stack = [root]
    while stack:
        node = stack.pop()
        if len(node.rows) <= leaf or node.radius == 0:
            continue
        part = x[node.rows]
        near = np.full(len(part), np.inf)
        owner = np.zeros(len(part), np.int64)
        pick, count = int(np.argmax(np.einsum("ij,ij->i", part - node.centre, part - node.centre))), 0
        # Centres until all rows lie within half the radius; a node of nearly equal distances stops at 16 balls.
        while count < 16:
            d = part - part[pick]
            d = np.einsum("ij,ij->i", d, d)
            closer = d < near
            near[closer], owner[closer] = d[closer], count
            count += 1
            pick = int(np.argmax(near))
            if near[pick] <= (node.radius / 2) ** 2:
                break
        for c in range(count):
            rows = node.rows[owner == c]
            if 0 < len(rows) < len(node.rows):
                node.children.append(ball(rows, x[rows].mean(axis=0)))
        stack += node.children
    return root


def dual_tree(q_ids, q, c_ids, c, k: int, floor: np.ndarray):
    """The k best (score, id) of the rows of c for each row of q, without the row's own id.

    ``floor`` is a score that each query is known to reach k times. Also returns which places are filled.
    """
    big = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
    exact = big * big * max(1, q.shape[1]) < 2**53
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    scores = np.full((len(q), k), -np.inf) if exact else np.full((len(q), k), np.iinfo(np.int64).min)
    ids = np.full((len(q), k), np.iinfo(np.int64).max)
    filled = np.zeros((len(q), k), bool)
    worst = floor.astype(np.float64).copy()
    slack = 1e-9 * big * big * max(1, q.shape[1]) + 1e-6

    def bound(a: Node, b: Node) -> float:
        return float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius + slack

    qt, ct = cover_tree(qf), cover_tree(cf)
    stack = [(bound(qt, ct), qt, ct)]
    while stack:
        top, a, b = stack.pop()
        if top < worst[a.rows].min():
            continue
        if a.children or b.children:
            if b.children and (not a.children or len(b.rows) >= len(a.rows)):
                pairs = [(bound(a, n), a, n) for n in b.children]
            else:
                pairs = [(bound(n, b), n, b) for n in a.children]
            stack += sorted(pairs, key=lambda p: p[0])
            continue
        got = (qf[a.rows] @ cf[b.rows].T) if exact else q[a.rows] @ c[b.rows].T
        own = q_ids[a.rows][:, None] == c_ids[b.rows][None, :]
        s = np.concatenate([scores[a.rows], got], axis=1)
        i = np.concatenate([ids[a.rows], np.broadcast_to(c_ids[b.rows], got.shape)], axis=1)
        ok = np.concatenate([filled[a.rows], ~own], axis=1)
        order = np.lexsort((i, -s, ~ok), axis=-1)[:, :k]
        scores[a.rows] = np.take_along_axis(s, order, 1)
        ids[a.rows] = np.take_along_axis(i, order, 1)
        filled[a.rows] = np.take_along_axis(ok, order, 1)
        full = filled[a.rows].all(axis=1)
        worst[a.rows] = np.where(full, np.maximum(worst[a.rows], scores[a.rows][:, -1]), worst[a.rows])
    return np.where(filled, scores, 0).astype(np.int64), ids, filled


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, without null ids and vectors that are null or hold null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
        .select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k candidates of the highest integer inner product for each query: query_id, rank, vec_id, score.

    Both tables hold (vec_id, v) of long components. Ties go to the smaller vec_id; candidates with
    the query's own id do not count; only vectors of equal length are compared. Rows equal in id and
    vector count once; one id with different vectors is several candidates and several queries. An
    empty table gives no rows, and a query with fewer than k candidates gets all of them.
    """
    queries = queries.select("vec_id", "v").distinct()
    # Of equal vectors only the k + 1 smallest ids can be results: cut before the shuffle, so a very common vector stays small.
    by_id = Window.partitionBy("v").orderBy("vec_id")
    rows = vectors.select("vec_id", "v").withColumn("n", F.dense_rank().over(by_id)).where(F.col("n") <= k + 1).drop("n").distinct()
    rows = written(rows, "topk-rows")
    queries = written(queries, "topk-queries")
    total, asked = rows.count(), queries.count()
    most = max(1, min(MOST_PIVOTS, math.ceil(total / 500)))
    # A bounded sample, spread by hash; it only shapes the cells and never decides on a result.
    pivots = [(r["vec_id"], np.array(r["v"], np.int64)) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most).collect()]
    groups = max(1, math.ceil(asked / GROUP_ROWS))

    def cells_of(batches):
        for pdf in batches:
            cell, dist = np.full(len(pdf), -1, np.int64), np.zeros(len(pdf))
            dims = pdf["v"].map(len).to_numpy()
            for d in np.unique(dims):
                at, own = np.flatnonzero(dims == d), [j for j, (_, p) in enumerate(pivots) if len(p) == d]
                if own:
                    x, p = np.stack(pdf["v"].iloc[at].to_list()).astype(np.float64), np.stack([pivots[j][1] for j in own]).astype(np.float64)
                    sq = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :]
                    best = sq.argmin(1)
                    cell[at], dist[at] = np.array(own)[best], np.sqrt(np.maximum(sq[np.arange(len(at)), best], 0))
                else:
                    cell[at] = -1 - d  # no pivot of this length: a cell of its own
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "cell": cell, "dist": dist})

    celled = rows.mapInPandas(cells_of, "vec_id long, v array<long>, cell long, dist double")
    shape = {r["cell"]: (r["n"], r["radius"]) for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).collect()}
    blocks = {c: max(1, math.ceil(n / block_rows)) for c, (n, _) in shape.items()}

    def deal_rows(batches):
        for pdf in cells_of(batches):
            spread = pd.util.hash_array(pdf["vec_id"].to_numpy()).astype(np.uint64)
            pdf["block"] = [int(s % blocks[c]) for s, c in zip(spread.tolist(), pdf["cell"], strict=True)]
            for g in range(groups):
                yield pdf[["cell", "block", "vec_id", "v"]].assign(grp=g)

    def deal_queries(batches):
        for pdf in batches:
            out = []
            for vec_id, v in zip(pdf["vec_id"], pdf["v"], strict=True):
                x = np.asarray(v, np.float64)
                norm, grp = math.sqrt(float(x @ x)), int(pd.util.hash_array(np.array([vec_id]))[0] % np.uint64(groups))
                near = {j: float(x @ p) for j, (_, p) in enumerate(pivots) if len(p) == len(x)}
                reached = sorted((s for j, s in near.items() if pivots[j][0] != vec_id), reverse=True)
                floor = reached[k - 1] - 1e-6 * (1 + abs(reached[k - 1])) if len(reached) >= k else -math.inf
                for c, (_, radius) in shape.items():
                    if (c in near and near[c] + norm * radius * (1 + 1e-9) + 1e-6 >= floor) or c == -1 - len(x):
                        out += [(c, b, grp, vec_id, v, floor) for b in range(blocks[c])]
            yield pd.DataFrame(out, columns=["cell", "block", "grp", "vec_id", "v", "floor"])

    def search(left, right):
        empty = pd.DataFrame({"query_id": [], "q_key": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "q_key": "int64", "vec_id": "int64", "score": "int64"})
        if not len(left) or not len(right):
            return empty
        q, c = np.stack(left["v"].to_list()).astype(np.int64), np.stack(right["v"].to_list()).astype(np.int64)
        keys = np.array([int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "little", signed=True) for r in q], np.int64)
        scores, ids, filled = dual_tree(left["vec_id"].to_numpy(), q, right["vec_id"].to_numpy(), c, k, left["floor"].to_numpy())
        keep, n = filled.ravel(), ids.shape[1]
        return pd.DataFrame(
            {"query_id": np.repeat(left["vec_id"].to_numpy(), n)[keep], "q_key": np.repeat(keys, n)[keep], "vec_id": ids.ravel()[keep], "score": scores.ravel()[keep]}
        )

    dealt_q = queries.mapInPandas(deal_queries, "cell long, block long, grp long, vec_id long, v array<long>, floor double")
    dealt_r = rows.mapInPandas(deal_rows, "cell long, block long, vec_id long, v array<long>, grp long")
    keys = ["cell", "block", "grp"]
    found = dealt_q.groupBy(*keys).cogroup(dealt_r.groupBy(*keys)).applyInPandas(search, "query_id long, q_key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "q_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_query(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
