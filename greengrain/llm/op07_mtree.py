"""Exact top-k search by inner product in a forest of M-trees.

Vectors of integers get one more coordinate, sqrt(M - |x|^2) with M the largest squared length, and queries a 0. In
that space all vectors have the same length, so the nearest by distance is the best by inner product, and a metric
tree applies. Rows are dealt by a hash of their id to trees of bounded size; a tree is a set of pages with routing
objects, covering radii and distances to the parent. A search takes pages in the order of their lower bound and skips
distances that the stored ones already exclude (triangle inequality). Scores are exact integers; bounds are floating
point with a slack, so a tie is never cut off.

Queries meet the trees in blocks: pages travel once per block of queries, queries once per tree, and at most k rows
per query and tree come back.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greengrain.functions.staging import stage

TREE_ROWS, PAGE_ROWS, FAN, BLOCK = 16384, 512, 8, 1024
PAGE_SCHEMA = ("node int, parent int, leaf boolean, n int, center binary, radius double, to_parent double, "
               "ids binary, vectors binary, to_center binary")


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; NULL for a vector with NULL or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale))))


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers; values beyond 64 bits stay at the end of the range."""
    size = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if size < 2.0 ** 53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    wide = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in x]
    return np.array([min(max(v, -2 ** 63), 2 ** 63 - 1) for v in wide], np.int64)


def _distance(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - center) ** 2).sum(axis=1))


def grow(rows: pd.DataFrame, longest: float, page_rows: int) -> pd.DataFrame:
    """The pages of one tree, root first; rows are (vec_id, v) with vectors of one length."""
    ids, flat = rows["vec_id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, flat = ids[order], flat[order]
    lifted = flat.astype(np.float64)
    lifted = np.hstack([lifted, np.sqrt(np.maximum(0.0, longest - (lifted ** 2).sum(axis=1)))[:, None]])
    pages = []

    def page(members: np.ndarray, parent: int, center: np.ndarray, above: np.ndarray | None) -> None:
        far = _distance(lifted[members], center)
        node = len(pages)
        leaf = len(members) <= page_rows
        pages.append((node, parent, leaf, len(members), center.tobytes(), float(far.max()),
                      0.0 if above is None else float(_distance(center[None], above)[0]),
                      ids[members].tobytes() if leaf else b"", flat[members].tobytes() if leaf else b"", far.tobytes() if leaf else b""))
        if leaf:
            return
        # routing objects: the farthest from those chosen so far; the rest goes to the nearest one
        chosen, near = [members[0]], _distance(lifted[members], lifted[members[0]])
        part = np.zeros(len(members), int)
        while len(chosen) < FAN and near.max() > 0:
            pick = members[int(near.argmax())]
            d = _distance(lifted[members], lifted[pick])
            part[d < near] = len(chosen)
            near = np.minimum(near, d)
            chosen.append(pick)
        if len(chosen) == 1:  # equal points: any cut will do
            for piece in np.array_split(members, FAN):
                if len(piece):
                    page(piece, node, lifted[piece[0]], center)
            return
        for c, at in enumerate(chosen):
            page(members[part == c], node, lifted[at], center)

    page(np.arange(len(ids)), -1, lifted[0], None)
    return pd.DataFrame(pages, columns=[c.split()[0] for c in PAGE_SCHEMA.split(", ")])


class Tree:
    """Pages of one tree, ready to search."""

    def __init__(self, pages: pd.DataFrame, dim: int):
        pages = pages.sort_values("node", ignore_index=True)
        self.center = np.stack([np.frombuffer(b) for b in pages["center"]])
        self.radius, self.to_parent = pages["radius"].to_numpy(), pages["to_parent"].to_numpy()
        self.leaf = pages["leaf"].to_numpy()
        self.ids = [np.frombuffer(b, np.int64) for b in pages["ids"]]
        self.vectors = [np.frombuffer(b, np.int64).reshape(-1, dim) for b in pages["vectors"]]
        self.small = [v.astype(np.float64) if np.abs(v).max(initial=0) < 2 ** 20 else None for v in self.vectors]
        self.to_center = [np.frombuffer(b) for b in pages["to_center"]]
        parent = pages["parent"].to_numpy()
        self.children = [np.empty(0, int)] * len(pages)
        order = np.argsort(parent, kind="stable")
        bounds = np.searchsorted(parent[order], np.arange(len(pages) + 1))
        for node in range(len(pages)):
            self.children[node] = order[bounds[node]:bounds[node + 1]]

    def best(self, query: int, q: np.ndarray, longest: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of this tree, without the query itself."""
        point = np.append(q.astype(np.float64), 0.0)
        length = float((point ** 2).sum()) + longest
        slack = 1e-6 * (1.0 + np.sqrt(length))
        plain = np.abs(q).max(initial=0) < 2 ** 20
        ids, scores, limit = np.empty(0, np.int64), np.empty(0, np.int64), np.inf
        worst = np.iinfo(np.int64).min
        start = float(_distance(self.center[:1], point)[0])
        heap = [(max(0.0, start - self.radius[0]), 0, start)]
        while heap:
            bound, node, away = heapq.heappop(heap)
            if bound > limit:
                break
            if self.leaf[node]:
                # the stored distance to the routing object excludes entries before their score is taken
                near = np.flatnonzero(np.abs(away - self.to_center[node]) <= limit)
                if plain and self.small[node] is not None and len(q) < 2 ** 12:
                    part = self.small[node] if len(near) == len(self.small[node]) else self.small[node][near]
                    got = (part @ point[:-1]).astype(np.int64)
                else:
                    got = inner(self.vectors[node][near], q)
                own = self.ids[node][near]
                good = np.flatnonzero((got >= worst) & (own != query))
                if not len(good):
                    continue
                ids, scores = np.concatenate([ids, own[good]]), np.concatenate([scores, got[good]])
                if len(ids) > k:
                    keep = np.lexsort((ids, ~scores))[:k]
                    ids, scores = ids[keep], scores[keep]
                if len(ids) == k:
                    worst = scores.min()
                    limit = np.sqrt(max(0.0, length - 2.0 * float(worst))) + slack
                continue
            kids = self.children[node]
            # the stored distance to the parent excludes a child before its own distance is taken
            kids = kids[np.abs(away - self.to_parent[kids]) - self.radius[kids] <= limit]
            if len(kids):
                d = _distance(self.center[kids], point)
                for kid, dist in zip(kids.tolist(), d.tolist()):
                    low = max(0.0, dist - self.radius[kid])
                    if low <= limit:
                        heapq.heappush(heap, (low, kid, dist))
        return ids, scores


def searcher(k: int, longest: float):
    def run(pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pages) and len(queries):
            tree = Tree(pages, int(queries["dim"].iloc[0]))
            for query, v in zip(queries["query_id"], queries["v"]):
                ids, scores = tree.best(int(query), np.asarray(v, np.int64), longest, k)
                out.append(pd.DataFrame({"query_id": np.int64(query), "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, tree_rows: int = TREE_ROWS,
          page_rows: int = PAGE_ROWS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of (vec_id, embedding) for each query, its own row apart.

    Ties go to the smaller vec_id. Vectors that are NULL or hold NULL or non-finite components, and rows without
    vec_id, take no part; vectors only meet vectors of their own length. Equal rows count as often as they occur as
    candidates, and once as queries. An empty table gives no rows; further columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"))
    rows = stage(rows.where("vec_id is not null and v is not null").withColumn("dim", F.size("v")), "vectors")
    long_ = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    queries = stage(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v", "dim").distinct(), "queries")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(long_).alias("longest")).first()
    longest = float(facts["longest"] or 0.0)
    trees = max(1, -(-facts["n"] // tree_rows))
    blocks = max(1, -(-queries.count() // block))
    dealt = rows.withColumn("tree", F.pmod(F.xxhash64("vec_id", "v"), F.lit(trees)))
    pages = stage(dealt.groupBy("dim", "tree").applyInPandas(tree_grower(longest, page_rows), f"dim int, tree long, {PAGE_SCHEMA}"), "pages")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = pages.withColumn("block", each(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("tree", each(trees))
    keys = ["dim", "tree", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        searcher(k, longest), "query_id long, vec_id long, score long")
    # at most k rows per tree and query
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def tree_grower(longest: float, page_rows: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pages = grow(rows, longest, page_rows)
        pages.insert(0, "dim", rows["dim"].iloc[0])
        pages.insert(1, "tree", rows["tree"].iloc[0])
        return pages
    return run
