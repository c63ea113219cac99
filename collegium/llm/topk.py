"""Exact top-k search by inner product: M-trees of bounded size, searched best first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from collegium.llm.common import materialise, slices
from collegium.llm.vectors import exact, finite, largest, whole

#: What components are multiplied by; results of a query; its id is a multiple of EVERY.
SCALE, K, EVERY = 64, 20, 20
#: Entries of a page, of a tree and queries of a block, at most or about (trees and blocks are dealt by hash).
PAGE, TREE, BLOCK = 256, 32_768, 32_768
#: Vectors for each routing object of the top level, and the most of these.
ROUTED, ROUTES = 4096, 256
#: Vectors that a task looks at together.
ROWS = 4096
#: Share by which a bound in floating point is raised, far above what rounding can lower it by.
SLACK = 1e-7

PAGES = "route int, tree int, page int, centre array<long>, radius double, parent_distance double, rows array<long>, ids array<long>, far array<double>, entries array<long>"
ASKED = "route int, tree int, block int, row long, id long, score double, least long, vector array<long>"
FOUND = "row long, query_id long, other long, vec_id long, score long"


def lengths(values: np.ndarray) -> np.ndarray:
    return np.sqrt((values.astype(np.float64) ** 2).sum(axis=1))


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to points, in floating point; users of it allow for SLACK."""
    a, b = rows.astype(np.float64), points.astype(np.float64)
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))


def vectors_of(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _listed(values: np.ndarray) -> pa.Array:
    """A list column of the rows of an array."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), pa.int64()))


def _routed(points: np.ndarray):
    """Each row under its nearest routing object, with its distance to that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = points.shape[1]
        for batch in slices(batches, ROWS):
            found = whole(batch.column("vector"), SCALE, dims)
            far = distances(found, points)
            route = far.argmin(axis=1) if len(found) else np.zeros(0, np.int64)
            least = far[np.arange(len(found)), route]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(route, pa.int32()), pa.array(least), _listed(found)], names=["row", "id", "route", "far", "vector"])

    return run


def bulk_load(vectors: np.ndarray, parent: np.ndarray, size: int) -> list[tuple[int, float, float, np.ndarray, np.ndarray]]:
    """Pages of at most `size` entries: (entry at the centre, radius, distance to the parent, entries, their distances).

    Entries evenly spread by their distance to the parent are centres; each entry goes to the nearest, and a page that
    is full goes on as another one about the same centre. Entries of a page are in falling order of distance.
    """
    n = len(vectors)
    to_parent = distances(vectors, parent[None])[:, 0]
    order = np.argsort(to_parent, kind="stable")
    centres = order[np.linspace(0, n - 1, -(-n // size)).astype(np.int64)]
    far = distances(vectors, vectors[centres])
    nearest = far.argmin(axis=1)
    pages = []
    for c, centre in enumerate(centres):
        own = np.flatnonzero(nearest == c)
        own = own[np.argsort(-far[own, c], kind="stable")]
        for at in range(0, len(own), size):
            part = own[at : at + size]
            pages.append((int(centre), float(far[part[0], c]), float(to_parent[centre]), part, far[part, c]))
    return pages


def _tree(points: np.ndarray, page: int):
    def run(table: pa.Table) -> pa.Table:
        dims = points.shape[1]
        batch = table.combine_chunks()
        route, tree = batch.column("route")[0].as_py(), batch.column("tree")[0].as_py()
        vectors = vectors_of(batch.column("vector").combine_chunks(), dims)
        rows, ids = batch.column("row").combine_chunks(), batch.column("id").combine_chunks()
        out = {name: [] for name in (x.split()[0] for x in PAGES.split(", "))}
        for i, (centre, radius, to_parent, own, far) in enumerate(bulk_load(vectors, points[route], page)):
            took = pa.array(own)
            for name, value in zip(out, (route, tree, i, vectors[centre], radius, to_parent, rows.take(took).to_numpy(), ids.take(took).to_pylist(), far, vectors[own].ravel())):
                out[name].append(value)
        types = [pa.int32()] * 3 + [pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
        return pa.table({name: pa.array(values, t) for (name, values), t in zip(out.items(), types)})

    return run


class Tree:
    """A tree's pages as arrays: the root's routing object with its entries, the pages, and their entries."""

    def __init__(self, pages: pa.Table, root: np.ndarray):
        dims = len(root)
        self.root = root
        self.centres = vectors_of(pages.column("centre").combine_chunks(), dims)
        self.radius = pages.column("radius").to_numpy()
        self.to_root = pages.column("parent_distance").to_numpy()
        lists = {n: pages.column(n).combine_chunks() for n in ("rows", "ids", "far", "entries")}
        self.ends = np.cumsum(np.diff(lists["rows"].offsets.to_numpy()))
        self.rows = lists["rows"].flatten().to_numpy()
        ids = lists["ids"].flatten()
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.far = lists["far"].flatten().to_numpy()
        self.entries = vectors_of(lists["entries"], dims)
        # Results stay below this, times the largest component of a query.
        self.most = dims * max(largest(self.entries), largest(root))

    def best(self, row: int, query: np.ndarray, least: int | None, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(entries, scores) of the k best by score, then id (none last), without the query's own row; those below
        `least` may be missing.

        An inner product is at most that with a ball's centre plus the query's length times the ball's radius. A page
        waits under the bound that its stored distance to the root gives, without being looked at, until that is the
        best bound there is; then its centre is measured, and it waits under its own bound. Entries are measured as
        far down their falling distances as a bound allows. The search ends when no page can reach the k-th score.
        """
        entries, centres, root, vector = exact(self.most * max(1, largest(query)), self.entries, self.centres, self.root, query)
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        slack = SLACK * (1 + length * float(self.radius.max() + self.to_root.max() + lengths(self.root[None])[0]))
        by_root = float(root @ vector) + length * (self.to_root + self.radius) + slack
        waiting = np.argsort(-by_root, kind="stable").tolist()
        waiting.reverse()
        open_: list[tuple[float, int, float]] = []
        floor = -np.inf if least is None else least
        held, scores = np.zeros(0, np.int64), np.zeros(0, vector.dtype)
        while waiting or open_:
            if waiting and (not open_ or by_root[waiting[-1]] >= -open_[0][0]):
                page = waiting.pop()
                if by_root[page] < floor:
                    waiting = []
                    continue
                centre = float(centres[page] @ vector)
                heapq.heappush(open_, (-(centre + length * self.radius[page] + slack), page, centre))
                continue
            bound, page, centre = heapq.heappop(open_)
            if -bound < floor:
                break
            lo, hi = self.ends[page - 1] if page else 0, self.ends[page]
            if floor > centre and length:  # entries nearer to the centre than this can't reach the k-th score
                hi = lo + np.searchsorted(-self.far[lo:hi], -(floor - centre - slack) / length, side="right")
            got = entries[lo:hi] @ vector
            good = np.flatnonzero(got >= floor)
            good = good[self.rows[lo + good] != row]
            if not len(good):
                continue
            held, scores = np.concatenate([held, lo + good]), np.concatenate([scores, got[good]])
            if len(held) > k:
                order = np.lexsort((self.ids[held], self.no_id[held], -scores)) if scores.dtype != object else sorted(range(len(held)), key=lambda i: (-scores[i], self.no_id[held[i]], self.ids[held[i]]))
                held, scores = held[order[:k]], scores[order[:k]]
            if len(held) == k:
                floor = max(floor, min(scores))
        return held, scores


def _search(points: np.ndarray, k: int):
    def run(pages: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]
        if pages.num_rows and asked.num_rows:
            tree = Tree(pages, points[pages.column("route")[0].as_py()])
            vectors = vectors_of(asked.column("vector").combine_chunks(), points.shape[1])
            for row, id_, least, vector in zip(asked.column("row").to_pylist(), asked.column("id").to_pylist(), asked.column("least").to_pylist(), vectors):
                held, scores = tree.best(row, vector, least, k)
                out[0] += [row] * len(held)
                out[1] += [id_] * len(held)
                out[2] += tree.rows[held].tolist()
                out[3] += [None if no else i for no, i in zip(tree.no_id[held].tolist(), tree.ids[held].tolist())]
                out[4] += [int(s) for s in scores]
        return pa.table([pa.array(x, pa.int64()) for x in out], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _asked(points: np.ndarray, radii: np.ndarray, trees: np.ndarray, blocks: int, first: bool):
    """The trees that a query asks: at first one under the routing object that promises most, then all others that
    can reach its k-th score so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.flatnonzero(trees)
        for batch in slices(batches, ROWS):
            vectors = vectors_of(batch.column("vector"), points.shape[1])
            length = lengths(vectors)
            score = vectors.astype(np.float64) @ points[held].astype(np.float64).T
            bound = (score + length[:, None] * radii[held]) + SLACK * (1 + length[:, None] * (radii[held] + lengths(points[held])))
            row = batch.column("row").to_numpy()
            home = held[bound.argmax(axis=1)] if len(row) else np.zeros(0, np.int64)
            home_tree = (row * 2654435761 % 4294967296) % trees[home] if len(row) else row
            if first:
                at, route, tree = np.arange(len(row)), home, home_tree
            else:
                least = batch.column("least").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                at, place = np.nonzero(bound >= least[:, None])
                times = trees[held[place]]
                at, route = np.repeat(at, times), np.repeat(held[place], times)
                tree = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                other = (route != home[at]) | (tree != home_tree[at])
                at, route, tree = at[other], route[other], tree[other]
            took = pa.array(at)
            block = (row[at] * 40503 // 65536) % blocks
            columns = [pa.array(route, pa.int32()), pa.array(tree, pa.int32()), pa.array(block, pa.int32()), *(batch.column(n).take(took) for n in ("row", "id")), pa.array(bound[at, np.searchsorted(held, route)]), batch.column("least").take(took), batch.column("vector").take(took)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ASKED.split(", ")])

    return run


def _answers(pages: DataFrame, asked: DataFrame, points: np.ndarray, k: int) -> DataFrame:
    """The results of queries in the trees that they ask; a tree goes to each block of queries that asks it."""
    keys = ["route", "tree", "block"]
    wanted = asked.select(*[F.col(c).alias(c) for c in keys]).distinct()
    met = pages.join(wanted, ["route", "tree"])
    return met.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(points, k), FOUND)


def routing_objects(rows: DataFrame, n: int, dims: int, each: int = ROUTED) -> np.ndarray:
    """Distinct vectors, one for about `each` rows and ROUTES at most, from a sample of some more by their hash."""
    wanted = min(ROUTES, max(1, n // each))
    tag = F.xxhash64("vector")
    share = max(1, n // (32 * wanted))
    found = rows.where(F.pmod(tag, F.lit(share)) == 0).select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(wanted)
    batches = [b for b in found.toArrow().combine_chunks().to_batches() if b.num_rows]
    return np.concatenate([whole(b.column("vector"), SCALE, dims) for b in batches]) if batches else np.zeros((1, dims), np.int64)


def top_scores(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, page: int = PAGE, tree: int = TREE, block: int = BLOCK, each: int = ROUTED) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k best other rows.

    The score is the inner product of components floor(64 x); ties go to the smaller id, a null id last. Vectors that
    are null or hold a null or non-finite component take no part; one that is shorter than another counts as if zeros
    followed. A row is not its own candidate, but a row that repeats its id is; each of several rows with one id is a
    query of its own. An empty table gives no rows, other columns are ignored, and a component or score that a
    long can't hold is an error.

    Exact, and all rows are indexed: each goes under the nearest of a bounded number of routing objects and, by hash,
    into a tree of about `tree` rows there, so a vector that many rows share is spread over trees. A query asks one tree
    first; its k-th score keeps it from trees whose balls can't reach it. On vectors without clusters hardly any tree
    is spared, and the work is that of all queries against all rows, in blocks.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(finite(F.col("vector")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims"), F.count_if(F.col("id") % every == 0).alias("asked")).head()
    dims, blocks = max(1, size.dims or 1), max(1, -(-size.asked // block))
    points = routing_objects(rows, size.n, dims, each)
    routed = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_routed(points), "row long, id long, route int, far double, vector array<long>")
    routed = materialise(routed, "routed")
    radii, trees = np.zeros(len(points)), np.zeros(len(points), np.int64)
    for r in routed.groupBy("route").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row for each routing object
        radii[r.route], trees[r.route] = r.far, -(-r.n // tree)
    count = F.element_at(F.array(*[F.lit(int(x)) for x in trees]), F.col("route") + 1)
    placed = routed.withColumn("tree", F.pmod(F.xxhash64("row"), F.greatest(count, F.lit(1))).cast("int"))
    pages = materialise(placed.groupBy("route", "tree").applyInArrow(_tree(points, page), PAGES), "pages")
    queries = routed.where(F.col("id") % every == 0).select("row", "id", "vector")
    ask = lambda q, first: q.mapInArrow(_asked(points, radii, trees, blocks, first), ASKED)
    home = materialise(_answers(pages, ask(queries.withColumn("least", F.lit(None).cast("long")), True), points, k), "home")
    least = home.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    rest = _answers(pages, ask(queries.join(least, "row", "left"), False), points, k)
    best = W.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "other")
    ranked = home.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
