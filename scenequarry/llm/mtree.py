"""Exact top-k by inner product with best-first search over M-trees.

Inner products become distances by one more coordinate: a candidate v gets
sqrt(M - |v|^2), M being the largest squared norm, and a query gets 0, so that
d(q, v)^2 = |q|^2 + M - 2 q.v and the nearest candidates are those of highest
score. Candidates are dealt to the nearest of some routing vectors and each
lot becomes an M-tree: pages of entries with a covering radius and the
distance to the parent's routing vector. A search visits pages by the best
score they could hold; the triangle inequality with the stored parent distance
drops entries before their own distance is computed.

An index has one file a tree in the shared folder, and a directory of two
levels of balls over the trees. Every query first searches its home tree, and
then only those other trees whose ball can still hold something better than
its k-th score. Scores and ties are decided on integers;
distances only prune, with some slack.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut_lineage, filesystem, held, publish

#: Rows of a tree, entries of a page, and queries searched together.
TREE_ROWS, PAGE, QUERY_BLOCK = 16_384, 128, 128
LARGEST = float(1 << 62)
VECTOR = "vec_id long, vector binary"
FOUND = "query_id long, query long, vec_id long, score long"


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of every component as little-endian 64-bit integers.

    Rows whose id or vector is null, or whose vector holds a null or a
    non-finite component, take no part. A component beyond ``LARGEST`` is an
    error, as are squared norms beyond it later on: scores must fit 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values
                if v is None or v.null_count:
                    continue
                x = v.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    if (np.abs(x) >= LARGEST / scale).any():
                        raise OverflowError(f"vector {i}: a component of {np.abs(x).max():g} times {scale} is too large")
                    ids.append(i)
                    out.append(np.floor(scale * x).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vector"])

    return rows.where("vec_id is not null and embedding is not null").select("vec_id", "embedding").mapInArrow(run, VECTOR)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros, which add nothing to a product."""
    return np.frombuffer(b"".join(v.ljust(8 * width, b"\0") for v in column), "<i8").reshape(-1, width)


def _norms(v: np.ndarray) -> np.ndarray:
    return (v.astype(float) ** 2).sum(axis=1)


class Space:
    """Distances between candidates in the widened space, and from queries to candidates."""

    def __init__(self, most: float):
        self.most = most

    def between(self, a: np.ndarray, a_norm: float, b: np.ndarray, b_norms: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(0, self.most - a_norm)) * np.sqrt(np.maximum(0, self.most - b_norms))
        return np.sqrt(np.maximum(0, 2 * self.most - 2 * (b.astype(float) @ a.astype(float)) - 2 * lift))

    def from_query(self, q_norm: float, products: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, q_norm + self.most - 2 * products))

    def best_score(self, q_norm: float, distance):
        """The highest score that anything at least so far away can have, with slack for rounding."""
        near = np.maximum(0, distance - 1e-7 * (np.sqrt(q_norm) + np.sqrt(self.most)) - 1e-6)
        return (q_norm + self.most - near * near) / 2 + 0.5


class MTree:
    """Pages in breadth-first order; an entry of an inner page is the page below it."""

    FIELDS = ("vectors", "ids", "to_parent", "node_from", "node_to", "node_leaf", "node_pivot", "node_radius", "node_to_parent", "node_least", "most")

    def __init__(self, **fields: np.ndarray):
        self.__dict__.update(fields)
        self.space = Space(float(self.most))
        self.floats = self.vectors.astype(float) if self.most < 2**52 else None

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, most: float, page: int = PAGE, fan: int = 16, seed: int = 3) -> "MTree":
        rng, space, norms = np.random.default_rng(seed), Space(most), _norms(vectors)
        order, nodes, queue = [], [], [(np.arange(len(ids)), 0, 0.0)]
        leaves: dict[int, np.ndarray] = {}
        while queue:
            rows, pivot, to_parent = queue.pop(0)
            far = space.between(vectors[pivot], norms[pivot], vectors[rows], norms[rows])
            node = {"pivot": pivot, "radius": far.max(initial=0.0), "to_parent": to_parent, "least": ids[rows].min() if len(rows) else 0}
            nodes.append(node)
            if len(rows) <= page:
                leaves[len(nodes) - 1] = rows
                continue
            seeds = rng.choice(rows, min(fan, -(-len(rows) // page)), replace=False)
            dist = np.stack([space.between(vectors[s], norms[s], vectors[rows], norms[rows]) for s in seeds], axis=1)
            near = dist.argmin(axis=1)
            if np.bincount(near).max() > 0.9 * len(rows):
                near = np.arange(len(rows)) * len(seeds) // len(rows)
            node["from"] = len(nodes) + len(queue)
            for i, s in enumerate(seeds):
                if (near == i).any():
                    queue.append((rows[near == i], int(s), float(space.between(vectors[pivot], norms[pivot], vectors[[s]], norms[[s]])[0])))
            node["to"] = len(nodes) + len(queue)
        start, to_parent = 0, []
        for i, rows in leaves.items():
            p = nodes[i]["pivot"]
            order.append(rows)
            to_parent.append(space.between(vectors[p], norms[p], vectors[rows], norms[rows]))
            nodes[i] |= {"from": start, "to": start + len(rows)}
            start += len(rows)
        order = np.concatenate(order)
        return cls(
            vectors=vectors[order], ids=ids[order], to_parent=np.concatenate(to_parent), most=np.float64(most),
            node_from=np.array([n["from"] for n in nodes]), node_to=np.array([n["to"] for n in nodes]), node_leaf=np.array([i in leaves for i in range(len(nodes))]),
            node_pivot=np.stack([vectors[n["pivot"]] for n in nodes]), node_radius=np.array([n["radius"] for n in nodes]),
            node_to_parent=np.array([n["to_parent"] for n in nodes]), node_least=np.array([n["least"] for n in nodes]),
        )

    def save(self, uri: str) -> None:
        fs, path = filesystem(uri)
        packed = io.BytesIO()
        np.savez(packed, **{f: getattr(self, f) for f in self.FIELDS})
        staged = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(staged) as f:
            f.write(packed.getbuffer())
        publish(fs, staged, path)

    @classmethod
    def load(cls, uri: str) -> "MTree":
        fs, path = filesystem(uri)
        with fs.open_input_file(path) as f, np.load(io.BytesIO(f.read())) as z:
            return cls(**{n: z[n] for n in cls.FIELDS})

    def products(self, q: np.ndarray, rows) -> np.ndarray:
        """Exact inner products: in doubles while these hold every partial sum (as norms bound it), else in integers."""
        if self.floats is not None and float(q @ q) * float(self.most) < 2.0**104:
            return (self.floats[rows] @ q).astype(np.int64)
        return self.vectors[rows] @ q.astype(np.int64)

    def search(self, query_id: int, q: np.ndarray, k: int, known: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
        """The k best (score, -vec_id) among ``known`` and the tree's rows other than the query's own, best first."""
        q = q.astype(float)
        q_norm, best = float(q @ q), sorted(known)
        root = float(self.space.from_query(q_norm, self.node_pivot[0].astype(float) @ q))
        heap = [(-float(self.space.best_score(q_norm, root - self.node_radius[0])), 0, root)]
        while heap:
            bound, node, far = heapq.heappop(heap)
            if len(best) == k and (-bound < best[0][0]):
                break
            a, b = int(self.node_from[node]), int(self.node_to[node])
            least = best[0] if len(best) == k else None
            if self.node_leaf[node]:
                rows = np.arange(a, b)
                if least:
                    rows = rows[self.space.best_score(q_norm, np.abs(far - self.to_parent[a:b])) >= least[0]]
                scores, ids = self.products(q, rows), self.ids[rows]
                good = ids != query_id
                if least:
                    good &= (scores > least[0]) | ((scores == least[0]) & (-ids > least[1]))
                scores, ids = scores[good], ids[good]
                if len(scores) > k:
                    top = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[top], ids[top]
                best = sorted([*best, *zip(scores.tolist(), (-ids).tolist())])[-k:]
                continue
            below = np.arange(a, b)
            if least:
                below = below[self.space.best_score(q_norm, np.abs(far - self.node_to_parent[a:b]) - self.node_radius[a:b]) >= least[0]]
            d = self.space.from_query(q_norm, self.node_pivot[below].astype(float) @ q)
            could = self.space.best_score(q_norm, d - self.node_radius[below])
            for n, dist, score in zip(below.tolist(), d.tolist(), could.tolist()):
                tied = least and score < least[0] + 1 and -self.node_least[n] < least[1]
                if not least or (score >= least[0] and not tied):
                    heapq.heappush(heap, (-score, n, dist))
        return best[::-1]


class Directory:
    """Where the trees lie: two levels of balls, so that neither a vector nor a query meets every tree.

    Routing vectors (one a lot) are dealt to about their square root of heads.
    A vector goes to the nearest head and there to the nearest routing vector.
    A head's ball covers the balls of its trees; a query looks at the trees of
    those heads alone whose ball can still hold something better. What is sent
    to the tasks is one vector a tree, about n / TREE_ROWS of them.
    """

    def __init__(self, pivots: np.ndarray, most: float):
        self.space, self.pivots, self.norms = Space(most), pivots, _norms(pivots)
        heads = np.arange(len(pivots))[: int(np.ceil(np.sqrt(len(pivots))))]
        self.heads = heads
        self.head_of = self._nearest(pivots, self.norms, heads)

    def _nearest(self, v: np.ndarray, norms: np.ndarray, among: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(0, self.space.most - norms))[:, None]
        lift = np.sqrt(np.maximum(0, self.space.most - self.norms[among]))
        return (v.astype(float) @ self.pivots[among].astype(float).T + own * lift).argmax(axis=1) if len(among) else np.zeros(len(v), int)

    def lots(self, v: np.ndarray) -> np.ndarray:
        """The lot of every vector."""
        norms, out = _norms(v), np.zeros(len(v), np.int64)
        head = self._nearest(v, norms, self.heads)
        for h in np.unique(head):
            rows, below = np.flatnonzero(head == h), np.flatnonzero(self.head_of == h)
            out[rows] = below[self._nearest(v[rows], norms[rows], below)]
        return out

    def hold(self, trees: pd.DataFrame, width: int) -> "Directory":
        """With the trees that were built: uri, lot, radius and pivot of each."""
        self.uris, self.radii = trees["uri"].tolist(), trees["radius"].to_numpy(float)
        self.centres = _matrix(trees["pivot"], width).astype(float)
        self.trees_of = [np.flatnonzero(self.head_of[trees["lot"].to_numpy(int)] == h) for h in range(len(self.heads))]
        self.reach = np.full(len(self.heads), -np.inf)
        for h, below in enumerate(self.trees_of):
            if len(below):
                c, own = self.pivots[self.heads[h]], self.norms[self.heads[h]]
                far = self.space.between(c, own, self.centres[below], (self.centres[below] ** 2).sum(axis=1))
                self.reach[h] = (far + self.radii[below]).max()
        return self

    def possible(self, q: np.ndarray, kth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of ``q``, trees, distances to the trees' centres, and the best scores possible there, where at least ``kth``."""
        q = q.astype(float)
        norms = (q * q).sum(axis=1)
        to_head = self.space.from_query(norms[:, None], q @ self.pivots[self.heads].astype(float).T)
        with np.errstate(invalid="ignore"):
            hope = self.space.best_score(norms[:, None], to_head - self.reach) >= kth[:, None]
        for h, below in enumerate(self.trees_of):
            rows = np.flatnonzero(hope[:, h])
            if len(rows) and len(below):
                far = self.space.from_query(norms[rows, None], q[rows] @ self.centres[below].T)
                could = self.space.best_score(norms[rows, None], far - self.radii[below])
                i, j = np.nonzero(could >= kth[rows, None])
                yield rows[i], below[j], far[i, j], could[i, j]

    def homes(self, q: np.ndarray) -> np.ndarray:
        """A tree near each query: the nearest of the nearest head that has trees."""
        q, out = q.astype(float), np.zeros(len(q), np.int64)
        norms = (q * q).sum(axis=1)
        to_head = self.space.from_query(norms[:, None], q @ self.pivots[self.heads].astype(float).T)
        to_head[:, [not len(t) for t in self.trees_of]] = np.inf
        head = to_head.argmin(axis=1)
        for h in np.unique(head):
            rows, below = np.flatnonzero(head == h), self.trees_of[h]
            out[rows] = below[(self.space.from_query(norms[rows, None], q[rows] @ self.centres[below].T)).argmin(axis=1)]
        return out


def _tasks(spark: SparkSession, groups: int) -> int:
    """Tasks for so many groups: a few for each core, and no more than 64 groups in one."""
    return max(1, min(groups, max(4 * spark.sparkContext.defaultParallelism, -(-groups // 64))))


def build_index(vectors: DataFrame, out: str, tree_rows: int = TREE_ROWS, seed: int = 3) -> tuple[Directory | None, int]:
    """Write one M-tree file a lot of about ``tree_rows`` rows below ``out``.

    Returns the directory (one row a tree, the only rows that come to the
    driver; None without vectors) and the width. A routing vector's lot that is
    too large, as with one very common vector, is dealt to several trees by id.
    ``vectors`` is read several times: cut its lineage before.
    """
    spark = vectors.sparkSession
    fs, path = filesystem(out)
    fs.create_dir(path, recursive=True)

    def squares(batches):
        for batch in batches:
            m = [float(_norms(np.frombuffer(v, "<i8")[None])[0]) for v in batch.column(1).to_pylist()]
            w = [len(v) // 8 for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([max(m, default=0.0)]), pa.array([max(w, default=0)], pa.int64()), pa.array([len(m)], pa.int64())], names=["m", "w", "n"])

    shape = vectors.mapInArrow(squares, "m double, w long, n long").agg(F.max("m").alias("m"), F.max("w").alias("w"), F.sum("n").alias("n")).first()
    most, width, n = float(shape.m or 0.0), max(1, shape.w or 1), shape.n or 0
    if most >= LARGEST:
        raise OverflowError(f"a squared norm of {most:g} does not fit a score")
    picked = vectors.dropDuplicates(["vector"]).orderBy(F.xxhash64(F.lit(seed), "vector"), "vector").limit(max(1, -(-n // tree_rows))).toPandas()
    if not len(picked):
        return None, width
    directory = Directory(_matrix(picked["vector"], width), most)
    routing = spark.sparkContext.broadcast(directory)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lots = routing.value.lots(_matrix(batch.column(1).to_pylist(), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lots)], names=["vec_id", "vector", "lot"])

    dealt = cut_lineage(vectors.mapInArrow(deal, VECTOR + ", lot long"))
    sizes = {int(r[0]): int(r[1]) for r in dealt.groupBy("lot").count().collect()}

    def grow(key: tuple, lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["vec_id", "vector"], ignore_index=True)
        tree = MTree.build(lot["vec_id"].to_numpy(), _matrix(lot["vector"], width), most)
        uri = f"{out}/tree-{key[0]}-{key[1]}.npz"
        tree.save(uri)
        return pd.DataFrame({"uri": [uri], "lot": [key[0]], "radius": [tree.node_radius[0]], "pivot": [tree.node_pivot[0].astype("<i8").tobytes()]})

    parts = spark.createDataFrame([(k, -(-v // tree_rows)) for k, v in sizes.items()], "lot long, parts long")
    salted = dealt.join(F.broadcast(parts), "lot").withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts"))).drop("parts")
    n_trees = sum(-(-v // tree_rows) for v in sizes.values())
    salted = salted.repartition(_tasks(spark, n_trees), "lot", "part")  # a number of its own, which is not folded together
    made = salted.groupBy("lot", "part").applyInPandas(grow, "uri string, lot long, radius double, pivot binary").toPandas()
    return directory.hold(made.sort_values("uri", ignore_index=True), width), width


def top_k(vectors: DataFrame, queries: DataFrame, out: str, k: int = 5, **how) -> DataFrame:
    """query_id, rank, vec_id and score: each query's ``k`` highest scores among all rows but
    those that share its id; ties go to the smaller vec_id; fewer rows give fewer ranks.

    Repeated rows count as candidates each, and a repeated query is searched
    once; queries that share an id but not the vector each get ranks of their
    own. Vectors of unequal width are filled with zeros. No vectors, or no
    queries, give no rows. Scores must fit 64 bits, else it is an error. Both
    tables are read several times: cut their lineage before.
    """
    spark = vectors.sparkSession
    directory, width = build_index(vectors, out, **how)
    if directory is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = queries.dropDuplicates(["vec_id", "vector"])
    n_trees = len(directory.uris)
    sent = spark.sparkContext.broadcast((directory, width))
    todo = "query_id long, query long, vector binary, tree long, kth long, kth_id long"

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, width = sent.value
        for batch in batches:
            if batch.num_rows:
                tree = directory.homes(_matrix(batch.column(2).to_pylist(), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree)], names=["query_id", "query", "vector", "tree"])

    def search(lot: pd.DataFrame) -> pd.DataFrame:
        """From the k-th score known (if any) on; what was known isn't repeated."""
        directory, width = sent.value
        uri = directory.uris[int(lot["tree"].iloc[0])]
        tree, out = held((MTree, uri), lambda: MTree.load(uri)), []
        for i, key, q, s, v in zip(lot["query_id"], lot["query"], _matrix(lot["vector"], width), lot["kth"], lot["kth_id"]):
            known = [] if pd.isna(s) else [(int(s), -int(v))] * k
            out += [(i, key, -b, a) for a, b in tree.search(i, q, k, known) if (a, b) not in known]
        return pd.DataFrame(out, columns=["query_id", "query", "vec_id", "score"]).astype("int64")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the trees that can still matter."""
        directory, width = sent.value
        schema = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vector", pa.binary()), ("tree", pa.int64()), ("kth", pa.int64()), ("kth_id", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            lot = batch.to_pandas(integer_object_nulls=True)
            kth = np.array([-np.inf if s is None else float(s) for s in lot["kth"]])
            for rows, trees, _, _ in directory.possible(_matrix(lot["vector"], width), kth):
                away = lot["tree"].to_numpy()[rows] != trees
                got = batch.take(pa.array(rows[away]))
                yield pa.RecordBatch.from_arrays([*got.columns[:3], pa.array(trees[away].astype(np.int64)), *got.columns[4:]], schema=schema)

    def searched(rows: DataFrame, n: int) -> DataFrame:
        block = F.pmod(F.xxhash64("query_id", "query"), F.lit(max(1, -(-n // QUERY_BLOCK)))).alias("block")
        groups = n_trees * max(1, -(-n // QUERY_BLOCK))
        return rows.select("*", block).repartition(_tasks(spark, groups), "tree", "block").groupBy("tree", "block").applyInPandas(search, FOUND)

    keyed = queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("vec_id", "vector").alias("query"), "vector")
    homed = cut_lineage(keyed.mapInArrow(homes, "query_id long, query long, vector binary, tree long"))
    n_queries = homed.count()
    none = F.lit(None).cast("long")
    first = cut_lineage(searched(homed.select("*", none.alias("kth"), none.alias("kth_id")), n_queries))
    place = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select("query_id", "query", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
    left = homed.join(kth, ["query_id", "query"], "left").select("query_id", "query", "vector", "tree", "kth", "kth_id")
    second = searched(left.mapInArrow(others, todo), n_queries)
    ranked = first.union(second).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
