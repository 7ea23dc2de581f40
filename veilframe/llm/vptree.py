"""Approximate nearest neighbours by largest inner product: a vantage-point tree for each shard.

Each shard's tree holds directions (vectors over their norms) and halves them by the median distance to a
vantage point; each node knows the smallest and largest norm below it. A search goes to the nearer half first
and skips the other where relax * radius < gap, gap being the distance from the query's direction to the
median sphere and radius the largest distance at which a row with a norm of that node still reaches the k-th
best inner product so far: relax 1 is the triangle inequality and exact; less skips more. As the norms enter
by the bound alone, a wide spread of them makes radii larger and the search slower, not recall smaller.
Candidates are scored again on the original vectors in double precision.

Vectors are dealt to shards by a hash, one row travelling once for each group of queries; a task holds one shard,
builds its tree over the distinct vectors once, and searches it with its group's queries as they come. Of each
shard and query k rows go on to the last ranking.

Defined results: vectors that are null, zero, or with null or non-finite components take no part; queries and
candidates of different lengths don't meet; a query row is not its own neighbour, but other rows under its id are
candidates, and each row of a repeated id is searched and found for itself; ties go to the smaller id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, default_parallelism

#: Rows of a shard and queries of a group at most, about (64 MB each with 64 dimensions), and rows of a shard where
#: there are tasks for more of them; queries searched at a time; rows of a leaf; vantage points tried for a node.
SHARD_ROWS, LEAST_SHARD_ROWS, QUERY_ROWS, LEAF_ROWS, TRIED = 131_072, 16_384, 1_024, 512, 8


class VPTree:
    """Flat arrays: node i has its vantage point, median distance, and halves, or is a leaf of rows."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        self.x = x
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []  # (vantage, median, near, far) or (start, stop)
        self.spans: list[tuple[int, int]] = []  # of order, by node
        rng = np.random.default_rng(seed)
        stack = [(0, len(x), None, 0)]
        while stack:
            start, stop, parent, side = stack.pop()
            here = len(self.nodes)
            self.spans.append((start, stop))
            if parent is not None:
                self.nodes[parent][2 + side] = here
            if stop - start <= leaf_rows:
                self.nodes.append((start, stop))
                continue
            rows = self.order[start:stop]
            # of some rows the one whose distances to others spread most
            seen, tried = x[rng.choice(rows, min(256, len(rows)), replace=False)], x[rng.choice(rows, min(TRIED, len(rows)), replace=False)]
            spread = ((seen[:, None] - tried[None]) ** 2).sum(axis=2)
            v = tried[int(np.sqrt(spread).std(axis=0).argmax())]
            d = np.sqrt(np.maximum(((x[rows] - v) ** 2).sum(axis=1), 0))
            mid = len(rows) // 2
            part = np.argpartition(d, mid)
            self.order[start:stop] = rows[part]
            self.nodes.append([v, float(d[part[mid]]), None, None])
            stack += [(start, start + mid, here, 0), (start + mid, stop, here, 1)]

    def _cost(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """What a search makes small, up to rounding: the squared distance of each query to each row."""
        y = self.x[rows]
        return np.maximum((q**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * (q @ y.T), 0)

    def _exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The cost by which rows are ranked, of pairs."""
        return ((q - self.x[rows]) ** 2).sum(axis=1)

    def _slack(self, q: np.ndarray) -> np.ndarray:
        """More than _cost and _exact may differ by."""
        return 1e-12 * ((q**2).sum(axis=1) + (self.x**2).sum(axis=1).max(initial=0))

    def _radius(self, q: np.ndarray, worst: np.ndarray, node: int) -> np.ndarray:
        """The distance within which a row of the node must lie to cost no more than worst."""
        return np.sqrt(np.maximum(worst, 0))

    def _place(self, q: np.ndarray) -> np.ndarray:
        """Where queries stand among the rows that the tree holds."""
        return q

    def search(self, q: np.ndarray, k: int, relax: float, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """For each query (k) row numbers and costs, -1 and inf where there are fewer, and the number of distances
        computed. Of rows with equal costs those of smallest rank (row number, if None) stay."""
        n = len(q)
        rank = np.arange(len(self.x)) if rank is None else rank
        best_d, best_i = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        work = 0
        where, slack = self._place(q), self._slack(q)
        todo: list[tuple[int, np.ndarray, np.ndarray]] = [(0, np.arange(n), np.full(n, -np.inf))]
        while todo:
            node, who, gap = todo.pop()
            live = gap <= relax * self._radius(q[who], best_d[who, -1] + slack[who], node) + 1e-9
            who = who[live]
            if not len(who):
                continue
            at = self.nodes[node]
            if len(at) == 2:
                rows = self.order[at[0] : at[1]]
                d = self._cost(q[who], rows)
                work += d.size
                top = best_d[who, -1]
                if len(rows) > k:
                    top = np.minimum(top, np.partition(d, k - 1, axis=1)[:, k - 1] + slack[who])
                # all that may stand among the k best, ranked by exact costs and then by rank
                i, j = np.nonzero(d <= (top + slack[who])[:, None])
                some = np.unique(i)
                old = best_i[who[some]]
                has = old >= 0
                owner = np.concatenate([np.repeat(some, k)[has.ravel()], i])
                row = np.concatenate([old[has], rows[j]])
                cost = np.concatenate([best_d[who[some]][has], self._exact(q[who[i]], rows[j])])
                order = np.lexsort((rank[row], cost, owner))
                owner, row, cost = owner[order], row[order], cost[order]
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                keep = place < k
                best_i[who[owner[keep]], place[keep]], best_d[who[owner[keep]], place[keep]] = row[keep], cost[keep]
                continue
            v, median, near, far = at
            d = np.sqrt(np.maximum(((where[who] - v) ** 2).sum(axis=1), 0))
            work += len(who)
            inside = d < median
            away = np.abs(d - median)
            # the other halves wait below the nearer ones on the stack, so those fill the best first
            for side, mask in ((far, inside), (near, ~inside)):
                if mask.any():
                    todo.append((side, who[mask], away[mask]))
            for side, mask in ((near, inside), (far, ~inside)):
                if mask.any():
                    todo.append((side, who[mask], np.full(mask.sum(), -np.inf)))
        return best_i, best_d, work


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows of x, whose squares may leave the range of a double."""
    top = np.abs(x).max(axis=1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / norms(x)[:, None]


class ProductTree(VPTree):
    """A tree over directions that is searched for the largest inner products with the vectors as they are."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        super().__init__(directions(x), leaf_rows, seed)
        self.whole, self.norms = x, norms(x)
        of = [self.norms[self.order[a:b]] for a, b in self.spans]
        self.low, self.high = [n.min() for n in of], [n.max() for n in of]

    def _cost(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return -(q @ self.whole[rows].T)

    def _exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return -np.einsum("ij,ij->i", q, self.whole[rows])

    def _slack(self, q: np.ndarray) -> np.ndarray:
        return 1e-12 * norms(q) * self.norms.max(initial=0)

    def _place(self, q: np.ndarray) -> np.ndarray:
        return directions(q)

    def _radius(self, q: np.ndarray, worst: np.ndarray, node: int) -> np.ndarray:
        # a positive product is reached at the widest angle by the longest row, a negative one by the shortest
        cosine = -worst / norms(q) / np.where(worst <= 0, self.high[node], self.low[node])
        return np.where(cosine <= -1, np.inf, np.sqrt(np.maximum(2 - 2 * cosine, 0)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, v array<double>, dim) of the vectors that take part; row numbers hold once this is stored."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim"))


class Shard:
    """The distinct vectors of a shard in a tree, and for each the rows that have it, smallest id first."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((row, ids))
        self.row, self.ids = row[order], ids[order]
        x = np.ascontiguousarray(x[order])
        # rows as opaque blocks of bytes
        _, first, which = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.x, self.least = x[first], self.ids[first]
        self.members = np.argsort(which, kind="stable")
        self.start = np.searchsorted(which[self.members], np.arange(len(first) + 1))
        self.tree = ProductTree(self.x)

    def nearest(self, row: np.ndarray, q: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, ...]:
        """(query number, vec_id, row, score) of the k nearest rows found for each query, less the query's own row."""
        # of vectors with equal products those whose smallest ids are smallest: they hold the k smallest ids
        at, _, _ = self.tree.search(q, min(k + 1, len(self.x)), relax, self.least)
        who, place = np.nonzero(at >= 0)
        hit = at[who, place]
        score = np.einsum("ij,ij->i", q[who], self.x[hit])
        n = np.minimum(self.start[hit + 1] - self.start[hit], k + 1)
        member = self.members[np.repeat(self.start[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        who, score = np.repeat(who, n), np.repeat(score, n)
        own = self.row[member] == row[who]
        who, score, member = who[~own], score[~own], member[~own]
        order = np.lexsort((self.row[member], self.ids[member], -score, who))
        who = who[order]
        keep = order[np.arange(len(who)) - np.searchsorted(who, who) < k]
        return who[np.arange(len(who)) - np.searchsorted(who, who) < k], self.ids[member[keep]], self.row[member[keep]], score[keep]


def nearest(vectors: DataFrame, is_query, k: int = 20, relax: float = 0.2, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which is_query(vec_id) holds, its k nearest found."""
    rows = cut(usable(vectors, id_col, vector_col), "vectors")
    asks = is_query(F.col("vec_id"))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("q")).where("q > 0").collect()  # a row for each length of vectors
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cores = default_parallelism(vectors.sparkSession)
    shards = {r.dim: max(-(-r.n // shard_rows), min(-(-r.n // min(LEAST_SHARD_ROWS, shard_rows)), 2 * cores)) for r in sizes}
    groups = {r.dim: max(-(-r.q // shard_rows), min(-(-r.q // query_rows), -(-cores // shards[r.dim]))) for r in sizes}
    of = lambda d: F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), F.col("dim"))
    part = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), of(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), of(n) - 1))
    live = rows.where(F.col("dim").isin(list(shards)))
    stored = live.select("dim", part(shards, 1).alias("shard"), every(groups).alias("grp"), F.lit(0).alias("asks"), "row", "vec_id", "v")
    asked = live.where(asks).select("dim", every(shards).alias("shard"), part(groups, 2).alias("grp"), F.lit(1).alias("asks"), "row", "vec_id", "v")
    tasks = sum(shards[d] * groups[d] for d in shards)
    both = stored.unionByName(asked).repartition(max(tasks, 1), "dim", "shard", "grp").sortWithinPartitions("dim", "shard", "grp", "asks")

    def meet(batches):
        now, shard, parts, waiting = None, None, [], []

        def joined(pieces):
            row, ids, x = (np.concatenate(c) for c in zip(*pieces))
            pieces.clear()
            return row, ids, x

        def found():
            row, ids, q = joined(waiting)
            for i in range(0, len(row), query_rows):
                who, other, other_row, score = shard.nearest(row[i : i + query_rows], q[i : i + query_rows], k, relax)
                yield pa.RecordBatch.from_arrays([pa.array(row[i : i + query_rows][who]), pa.array(ids[i : i + query_rows][who]), pa.array(other), pa.array(other_row), pa.array(score)], names=["query_row", "query_id", "vec_id", "row", "score"])

        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if b.num_rows else []
            for a, z in zip([0, *edges], [*edges, b.num_rows]):
                if a == z:
                    continue
                key, query = tuple(keys[a, :3]), keys[a, 3]
                if key != now:
                    if waiting:
                        yield from found()
                    now, shard = key, None
                    parts.clear()
                c = b.slice(a, z - a)
                piece = c.column(4).to_numpy(), c.column(5).to_numpy(), c.column(6).flatten().to_numpy().reshape(z - a, -1)
                if not query:
                    parts.append(piece)
                    continue
                if shard is None and parts:
                    shard = Shard(*joined(parts))
                if shard is not None:
                    waiting.append(piece)
                    if sum(len(w[0]) for w in waiting) >= query_rows:
                        yield from found()
        if waiting:
            yield from found()

    hits = both.select("dim", "shard", "grp", "asks", "row", "vec_id", "v").mapInArrow(meet, "query_row long, query_id long, vec_id long, row long, score double")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
