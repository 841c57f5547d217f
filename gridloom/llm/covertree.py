"""Exact top-k by inner product with cover trees of the queries and of the data, walked together.

Vectors are dealt to cells by the nearest of some centres, so that each block of a cell holds points that are near each
other. Each block gets its own cover tree, built once and written. A pair of blocks is searched only if the bound of
their balls reaches the worst kth score of the block of queries, which its most promising block of data has set before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import discard, settle

#: Vectors of one block of data and of one block of queries; each pair of blocks is one task's work.
DATA_BLOCK, QUERY_BLOCK = 8192, 4096
#: Vectors from which the centres of the cells are chosen; every vector is then dealt and indexed.
SAMPLE, CENTRES = 8192, 1024
#: Blocks of data whose balls meet a block of queries at once.
BALLS = 1024
#: The cover distance shrinks by this from one level to the next. In many dimensions distances are alike, so that a
#: larger step would leave one level only.
BASE = 1.25
#: Points that a node takes as children at once, and queries that are searched for together.
FEW, GROUP = 16, 16
#: Points whose distances are all held at once.
MATRIX = 2048
#: Data nodes that a group of queries looks at in one step.
STEP = 4096
#: A group of queries parts where each needs less than this fraction of the nodes that the group needs.
SPLIT = 3
LONG_MAX = (1 << 63) - 1


# --- the tree ------------------------------------------------------------------------------------------------------


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(((points - centre) ** 2).sum(1))


def centres_of(points: np.ndarray, cover: float) -> tuple[list[int], list[np.ndarray]]:
    """Centres more than ``cover`` apart, each the farthest from those before, and the points that each covers first."""
    centres, covered = [], []
    rest = np.arange(len(points))
    matrix = None
    if len(points) <= MATRIX:
        squares = (points**2).sum(1)
        matrix = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * points @ points.T, 0))
    away = np.full(len(points), np.inf)
    while len(rest):
        pick = rest[int(away.argmax())]
        to = matrix[pick, rest] if matrix is not None else _distances(points[rest], points[pick])
        near = (to <= cover) | (rest == pick)
        centres.append(int(pick))
        covered.append(rest[near & (rest != pick)])
        rest, away = rest[~near], np.minimum(away, to)[~near]
    return centres, covered


def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, radius): each point is a node once, at the highest level at which it is a centre.

    The points under a node follow it in ``order``, ``parent`` is a place in the order (-1 for the root), and all points
    under a node lie within its radius. A node's children are, level by level, centres more than the level's cover
    distance apart; the points that the node itself covers go on to the next level.
    """
    n = len(points)
    order, parent, radius = np.empty(n, np.int64), np.full(n, -1, np.int32), np.zeros(n)
    todo, at = ([(0, np.arange(1, n), -1)] if n else []), 0
    while todo:
        centre, members, up = todo.pop()
        here, at = at, at + 1
        order[here], parent[here] = centre, up
        if not len(members):
            continue
        away = _distances(points[members], points[centre])
        radius[here] = float(away.max()) * (1 + 1e-9)  # rounding must not cut a point off
        most = away.max()
        while len(members) > FEW and 0 < most < np.inf:
            cover = most / BASE
            far = away > cover
            outer = members[far]
            centres, covered = centres_of(points[outer], cover)
            todo += [(int(outer[c]), outer[own], here) for c, own in zip(centres, covered, strict=True)]
            members, away = members[~far], away[~far]
            most = away.max(initial=0)
        todo += [(int(m), members[:0], here) for m in members]
    return order, parent, radius


class Tree:
    """Points in the order of a cover tree, with their ids, radii and children."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, parent: np.ndarray, radius: np.ndarray):
        self.points, self.ids, self.radius = points, ids, radius
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((points**2).sum(1))
        self.largest = np.abs(points).max(initial=0)
        self.kids = np.argsort(parent, kind="stable")
        self.first = np.searchsorted(parent[self.kids], np.arange(len(points) + 1))
        size = np.ones(len(points), np.int64)
        for i in range(len(points) - 1, 0, -1):
            size[parent[i]] += size[i]
        self.size = size
        depth = np.zeros(len(points), np.int64)
        for i in range(1, len(points)):
            depth[i] = depth[parent[i]] + 1
        self.depth = int(depth.max(initial=0)) + 1

    @classmethod
    def of(cls, points: np.ndarray, ids: np.ndarray) -> Tree:
        order, parent, radius = build_tree(points)
        return cls(points[order], ids[order], parent, radius)

    def children(self, nodes: np.ndarray) -> np.ndarray:
        start, n = self.first[nodes], self.first[nodes + 1] - self.first[nodes]
        return self.kids[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def to_bytes(self) -> tuple[str, bytes]:
        """The numbers in the narrowest type that holds them, then ids, parents and radii."""
        kind = next(k for k in ("<i2", "<i4", "<f8") if k == "<f8" or self.largest < np.iinfo(k).max)
        parent = np.full(len(self.ids), -1, np.int32)
        for i in range(len(self.ids)):
            parent[self.kids[self.first[i] : self.first[i + 1]]] = i
        return kind, self.points.astype(kind).tobytes() + self.ids.tobytes() + parent.tobytes() + self.radius.tobytes()

    @classmethod
    def from_bytes(cls, kind: str, raw: bytes, n: int, size: int) -> Tree:
        at = n * size * np.dtype(kind).itemsize
        points = np.frombuffer(raw, kind, n * size).reshape(n, size).astype(np.float64)
        ids = np.frombuffer(raw, np.int64, n, at)
        parent = np.frombuffer(raw, np.int32, n, at + 8 * n)
        return cls(points, ids, parent, np.frombuffer(raw, np.float64, n, at + 12 * n))


# --- the search ----------------------------------------------------------------------------------------------------


def _exact(q: np.ndarray, x: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of whole numbers: in doubles where these are exact, else in Python's integers, cut to long."""
    if small:
        return (q @ x.T).astype(np.int64)
    big = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.array([[max(-LONG_MAX - 1, min(LONG_MAX, v)) for v in r] for r in big], object).astype(np.int64).reshape(len(q), len(x))


class Best:
    """The k best (score, smallest id) of each query so far. ``floor``: a kth score known from elsewhere."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.score = np.full((n, k), -LONG_MAX - 1, np.int64)
        self.id = np.full((n, k), LONG_MAX, np.int64)
        self.have = np.zeros((n, k), bool)
        self.floor = np.full(n, -LONG_MAX - 1, np.int64) if floor is None else floor
        self.looked = 0

    def least(self, rows: np.ndarray) -> np.ndarray:
        """The score that a point must reach for each query."""
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Take in scores of rows (a matrix) with points ``ids``, as far as they are allowed."""
        k = self.score.shape[1]
        self.looked += score.size
        score = np.where(allowed, score, -LONG_MAX - 1)
        high = self.least(rows)
        if score.shape[1] > k:
            high = np.maximum(high, np.partition(score, -k, axis=1)[:, -k])
        r, c = np.nonzero((score >= high[:, None]) & allowed)
        if not len(r):
            return
        old_r, old_c = np.nonzero(self.have[rows])
        row = np.r_[old_r, r]
        value = np.r_[self.score[rows][old_r, old_c], score[r, c]]
        own = np.r_[self.id[rows][old_r, old_c], ids[c]]
        order = np.lexsort((own, ~value, row))  # ~v falls as v rises, without overflow
        row, value, own = row[order], value[order], own[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        at = (rows[row[keep]], place[keep])
        self.score[at], self.id[at], self.have[at] = value[keep], own[keep], True


def search(qt: Tree, xt: Tree, k: int, floor: np.ndarray | None = None) -> Best:
    """The k best points of a data tree for each query of a query tree.

    All points under a query node q score at most q.x + |q| r_x + |x| r_q + r_q r_x with points under a data node x; a pair
    of nodes goes if that is below the worst kth score of the query node's queries, and stays at a tie. The wider of both
    is divided. Small query nodes of one parent are searched for together: a data node is looked at as a point first, and
    its children follow if one of the queries may find a better point under it.
    """
    best = Best(len(qt.ids), k, floor)
    if not len(qt.ids) or not len(xt.ids):
        return best
    with np.errstate(over="ignore"):
        small = qt.largest * xt.largest * max(qt.points.shape[1], 1) < 2**53
    # radius -1: the point alone
    reach = np.where(xt.size > 1, xt.radius * (1 + 1e-9) + 1e-9 * xt.norm, -1.0)
    # (query node, data nodes, their radii)
    todo = [(0, np.zeros(1, np.int64), reach[:1])]
    while todo:
        a, nodes, radius = todo.pop()
        rows = np.arange(a, a + qt.size[a])
        wide = qt.radius[a]
        while len(rows) > GROUP and len(nodes):
            below = np.maximum(radius, 0)
            high = xt.points[nodes] @ qt.points[a] + qt.norm[a] * below + (xt.norm[nodes] + below) * wide * (1 + 1e-9)
            live = ~(high < best.least(rows).min())
            nodes, radius = nodes[live], radius[live]
            divide = radius > wide
            if not divide.any():
                break
            kids = xt.children(nodes[divide])
            nodes = np.r_[nodes, kids]
            radius = np.r_[np.where(divide, -1.0, radius), reach[kids]]
        if not len(nodes):
            continue
        if len(rows) <= GROUP:
            _search_group(qt, xt, rows, nodes, radius, best, small, reach)
            continue
        kids, held = qt.children(np.array([a])), [a]
        for kid in kids[qt.size[kids] <= GROUP]:
            if len(held) + qt.size[kid] > GROUP:
                _search_group(qt, xt, np.array(held), nodes, radius, best, small, reach)
                held = []
            held += range(kid, kid + qt.size[kid])
        if held:
            _search_group(qt, xt, np.array(held), nodes, radius, best, small, reach)
        todo += [(int(kid), nodes, radius) for kid in kids[qt.size[kids] > GROUP]]
    return best


def _search_group(qt: Tree, xt: Tree, rows, nodes, radius, best: Best, small: bool, reach) -> None:
    """The data nodes for a group of queries; where the queries need few nodes in common, each goes on by itself."""
    todo = [(rows, nodes, radius)]
    while todo:
        rows, nodes, radius = todo.pop()
        if len(nodes) > STEP:
            todo += [(rows, nodes[STEP:], radius[STEP:]), (rows, nodes[:STEP], radius[:STEP])]
            continue
        score = _exact(qt.points[rows], xt.points[nodes], small)
        best.offer(rows, score, xt.ids[nodes], qt.ids[rows][:, None] != xt.ids[nodes][None, :])
        inner = radius >= 0
        if not inner.any():
            continue
        nodes, radius = nodes[inner], radius[inner]
        slack = score[:, inner] + qt.norm[rows][:, None] * radius - best.least(rows)[:, None]
        live = ~(slack < 0)
        shared = live.any(0)
        if live.sum() * SPLIT < len(rows) * shared.sum():
            parts = [(rows[i : i + 1], nodes[live[i]], slack[i, live[i]]) for i in range(len(rows))]
        else:
            parts = [(rows, nodes[shared], slack[:, shared].max(0))]
        for own, at, high in parts:
            kids = xt.children(at[np.argsort(-high, kind="stable")])
            if len(kids):
                todo.append((own, kids, reach[kids]))


# --- on Spark ------------------------------------------------------------------------------------------------------

_TREES = "size int, block string, kind string, n int, centre binary, radius double, tree binary"


def _cells(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """For each length of vectors centres of cells of about DATA_BLOCK vectors, at most CENTRES in all, from a sample of
    about SAMPLE vectors: the first centres of a cover tree, each the farthest from those before."""
    chosen = vectors if n <= SAMPLE else vectors.filter(F.pmod(F.xxhash64("id", "row"), F.lit(n)) < SAMPLE)
    rows = sorted((r["size"], bytes(r["v"])) for r in chosen.select("size", "v").limit(2 * SAMPLE).collect())
    out, wanted = {}, min(CENTRES, -(-n // DATA_BLOCK))
    for size in {s for s, _ in rows}:
        own = [v for s, v in rows if s == size]
        points = np.frombuffer(b"".join(own), np.float64).reshape(len(own), size)
        count = max(1, wanted * len(points) // len(rows))
        order, away = [0], _distances(points, points[0])
        while len(order) < min(count, len(points)):
            order.append(int(away.argmax()))
            away = np.minimum(away, _distances(points, points[order[-1]]))
        out[size] = points[order]
    return out


def _trees(vectors: DataFrame, block: int, name: str) -> DataFrame:
    """A cover tree for each block of at most about ``block`` vectors of one cell."""
    sizes = vectors.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("parts"))
    dealt = vectors.join(sizes, ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        size, cell, part = key
        pdf = pdf.sort_values(["id", "row"], kind="stable")
        points = np.frombuffer(b"".join(pdf["v"]), np.float64).reshape(len(pdf), int(size))
        tree = Tree.of(points, pdf["id"].to_numpy(np.int64))
        kind, raw = tree.to_bytes()
        row = (int(size), f"{cell}.{part}", kind, len(pdf), tree.points[0].tobytes(), float(tree.radius[0]), raw)
        return pd.DataFrame([row], columns=[c.split()[0] for c in _TREES.split(", ")])

    return settle(dealt.groupBy("size", "cell", "part").applyInPandas(build, _TREES), name)


def _block_pairs(asked: DataFrame, data: DataFrame) -> DataFrame:
    """(size, q, d, bound): the highest score that a block of data may give to a block of queries."""
    numbered = data.select("size", "block", "centre", "radius", F.pmod(F.xxhash64("block"), F.lit(max(1, -(-data.count() // BALLS)))).alias("g"))
    balls = numbered.groupBy("size", "g").agg(F.collect_list(F.struct("block", "centre", "radius")).alias("balls"))
    groups = balls.select("size", "g").groupBy("size").agg(F.collect_list("g").alias("groups"))
    met = asked.select("size", F.col("block").alias("q"), "centre", "radius").join(groups, "size")
    met = met.withColumn("g", F.explode("groups")).drop("groups").join(balls, ["size", "g"])

    def bound(batches):
        for pdf in batches:
            for size, q, centre, radius, balls in zip(*(pdf[c] for c in ("size", "q", "centre", "radius", "balls")), strict=True):
                c = np.frombuffer(centre, np.float64)
                x = np.array([np.frombuffer(b["centre"], np.float64) for b in balls]).reshape(len(balls), len(c))
                r = np.array([b["radius"] for b in balls])
                with np.errstate(over="ignore", invalid="ignore"):
                    norm, norms = np.sqrt((c**2).sum()), np.sqrt((x**2).sum(1))
                    high = x @ c + norm * r + norms * radius + r * radius + 1e-9 * (norms + r) * (norm + radius)
                yield pd.DataFrame({"size": size, "q": q, "d": [b["block"] for b in balls], "bound": np.nan_to_num(high, nan=np.inf)})

    return settle(met.mapInPandas(bound, "size int, q string, d string, bound double"), "pairs")


def _search_pairs(pairs: DataFrame, asked: DataFrame, data: DataFrame, k: int, floors: DataFrame | None) -> DataFrame:
    """(size, q, query_id, vec_id, score): what each pair of blocks (size, q, d) finds, a task for each pair."""
    left = asked.select("size", F.col("block").alias("q"), F.struct("kind", "n", "tree").alias("asks"))
    if floors is not None:
        left = left.join(floors, ["size", "q"], "left")
    else:
        left = left.withColumn("floors", F.lit(None).cast("map<bigint,bigint>"))
    right = data.select("size", F.col("block").alias("d"), F.struct("kind", "n", "tree").alias("has"))
    both = pairs.select("size", "q", "d").join(left, ["size", "q"]).join(right, ["size", "d"])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        size, q, _ = key
        row = pdf.iloc[0]
        qt, xt = (Tree.from_bytes(t["kind"], t["tree"], int(t["n"]), int(size)) for t in (row["asks"], row["has"]))
        known = dict(row["floors"]) if row["floors"] is not None else {}
        floor = np.array([known.get(i, -LONG_MAX - 1) for i in qt.ids.tolist()], np.int64)
        best = search(qt, xt, k, floor)
        rows, cols = np.nonzero(best.have)
        out = {"size": size, "q": q, "query_id": qt.ids[rows], "vec_id": best.id[rows, cols], "score": best.score[rows, cols]}
        return pd.DataFrame(out).astype({"size": "int32"})

    found = both.groupBy("size", "q", "d").applyInPandas(run, "size int, q string, query_id long, vec_id long, score long")
    return settle(found, "found")


def top_k(
    df: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with all other rows.

    Components x count as floor(scale * x). Queries are the rows whose id is divisible by ``every``, candidates all
    rows but the query's own id; ties go to the smaller id, and a query with fewer candidates gets all. Null ids, null
    vectors and vectors with a null or non-finite component (also after scaling) take no part; vectors of different
    lengths are not compared, empty ones score 0. Scores beyond long are cut to its ends. Of rows with one id each is
    a candidate of its own and a query of its own only once, by its least vector. Empty tables give an empty result;
    other columns are ignored. Ids are whole numbers, or strings of them.
    """
    vectors = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("raw"))
    scaled = F.transform("raw", lambda v: v.cast("double") * F.lit(scale))
    sound = F.forall(scaled, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    vectors = vectors.filter("id is not null and raw is not null").filter(sound)

    def floor(batches):
        for pdf in batches:
            values = [np.floor(np.asarray(v, np.float64) * scale) + 0.0 for v in pdf["raw"]]
            yield pd.DataFrame(
                {"id": pdf["id"], "size": [len(v) for v in values], "v": [v.tobytes() for v in values], "row": pdf["row"]}
            )

    vectors = vectors.select("id", "raw", F.monotonically_increasing_id().alias("row"))
    vectors = settle(vectors.mapInPandas(floor, "id long, size int, v binary, row long"), "vectors")
    centres = _cells(vectors, max(1, vectors.count()))

    def deal(batches):
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int32)
            for size, at in pdf.groupby("size").indices.items():
                c = centres.get(int(size))
                if c is not None and len(c) > 1:
                    x = np.frombuffer(b"".join(pdf["v"].iloc[at]), np.float64).reshape(len(at), int(size))
                    with np.errstate(over="ignore", invalid="ignore"):
                        cell[at] = np.nan_to_num((c**2).sum(1) - 2 * x @ c.T, nan=np.inf).argmin(1)
            yield pdf.assign(cell=cell)

    dealt = settle(vectors.mapInPandas(deal, "id long, size int, v binary, row long, cell int"), "dealt")
    discard(vectors)
    # of rows with one id the one with the least vector asks
    queries = dealt.filter(F.col("id") % every == 0)
    asks = queries.groupBy("id").agg(F.min(F.struct("size", "v", "row", "cell")).alias("q")).select("id", "q.*")
    asked, data = _trees(asks, QUERY_BLOCK, "asked"), _trees(dealt, DATA_BLOCK, "data")
    pairs = _block_pairs(asked, data)
    # the most promising block of data sets the kth scores that the others must reach
    first = pairs.groupBy("size", "q").agg(F.max(F.struct("bound", "d")).alias("m")).select("size", "q", "m.d")
    first = settle(first, "first")
    found = _search_pairs(first, asked, data, k, None)
    kth = found.groupBy("size", "q", "query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    floors = kth.groupBy("size", "q").agg(
        F.map_from_entries(F.collect_list(F.struct("query_id", "kth"))).alias("floors"), F.min("kth").alias("least"), F.count(F.lit(1)).alias("known")
    )  # at most a block of queries
    floors = settle(floors, "floors")
    n = asked.select("size", F.col("block").alias("q"), "n")
    worst = n.join(floors, ["size", "q"], "left").select("size", "q", F.when(F.col("known") == F.col("n"), F.col("least")).alias("worst"))
    rest = pairs.join(first, ["size", "q", "d"], "left_anti").join(worst, ["size", "q"])
    rest = rest.filter("worst is null or bound >= worst")
    found = found.unionByName(_search_pairs(rest, asked, data, k, floors.select("size", "q", "floors")))
    discard(dealt, asked, data, pairs, first, floors)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
