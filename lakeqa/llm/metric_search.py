"""Exact top-k by inner product: M-trees over shards, searched best first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakeqa.scale import cut_lineage

LEAF = 128
FANOUT = 16
SHARD_ROWS = 8192
# Vectors that shard centres are chosen from: a bound; every vector is indexed whatever the centres.
SAMPLE_ROWS = 4096
QUERY_BLOCK = 2048
# The directory of centres and radii goes to every task, so there are never many more shards.
MOST_SHARDS = 1 << 16
# Rounding of distances and products of whole numbers, as a share, is far below this.
SLACK = 1e-9


def whole_vectors(vectors: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """id and ``v``: floor(scale * x) of every component. Rows with null id, vector or component, or
    one that isn't finite, are left out; so are vectors without components."""
    x = F.col(f"`{vector}`")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    rows = vectors.where(F.col(f"`{id}`").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
    parts = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    return rows.select(F.col(f"`{id}`").cast("bigint").alias("id"), parts.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Vectors as lines, shorter ones filled up with zeros."""
    lists = column.to_pylist()
    out = np.zeros((len(lists), size), np.float64)
    for line, values in zip(out, lists, strict=True):
        line[: len(values)] = values
    return out


class Page:
    """A node: entries with centre, radius and distance to the node's own centre; a leaf's are vectors."""

    __slots__ = ("centres", "children", "ids", "parent", "radii")

    def __init__(self, centres, radii, parent, children, ids):
        self.centres, self.radii, self.parent, self.children, self.ids = centres, radii, parent, children, ids


def build_tree(vectors: np.ndarray, ids: np.ndarray, seed: int = 1) -> tuple[Page, np.ndarray, float]:
    """Root page, its centre and its covering radius, bulk-loaded from the top: entries go to the
    nearest of FANOUT spread-out centres, until a page's vectors fit a leaf."""
    draw = np.random.default_rng(seed)

    def grow(rows: np.ndarray, centre: np.ndarray) -> tuple[Page, float]:
        distances = np.linalg.norm(vectors[rows] - centre, axis=1)
        radius = float(distances.max(initial=0.0))
        if len(rows) <= LEAF or radius == 0:
            return Page(vectors[rows], np.zeros(len(rows)), distances, None, ids[rows]), radius
        picked = rows[draw.choice(len(rows), min(FANOUT, len(rows)), replace=False)]
        centres = np.unique(vectors[picked], axis=0)
        near = ((vectors[rows] ** 2).sum(1)[:, None] - 2 * vectors[rows] @ centres.T + (centres**2).sum(1)).argmin(1)
        groups = [rows[near == k] for k in range(len(centres))]
        if max(map(len, groups)) == len(rows):  # one centre took all: split by order, which any page may be
            groups, centres = np.array_split(rows, FANOUT), vectors[[g[0] for g in np.array_split(rows, FANOUT)]]
        grown = [(c, *grow(g, c)) for c, g in zip(centres, groups, strict=True) if len(g)]
        middles = np.array([c for c, _, _ in grown])
        return Page(middles, np.array([r for _, _, r in grown]), np.linalg.norm(middles - centre, axis=1), [p for _, p, _ in grown], None), radius

    centre = vectors.mean(axis=0)
    page, radius = grow(np.arange(len(vectors)), centre)
    return page, centre, radius


class Search:
    """The ``k`` best vectors of a tree for each of some queries, all searched together, best page first.

    For a centre p with radius r, no vector below scores more than q.p + |q| r. That p's product
    itself lies within |q| d(p, parent) of the parent's is known without computing it, so entries
    that can't reach any query's k-th score by their stored distance alone are never multiplied, and
    a page only meets the queries that it may still serve: one matrix product for all of them.
    Pages come by the highest bound of any query. ``work`` counts each query's products. A query with a
    finite ``floor`` only wants scores from that on.
    """

    def __init__(self, queries: np.ndarray, owns: np.ndarray, k: int, floors: np.ndarray):
        self.queries, self.owns, self.k, self.floors = queries, owns, k, floors
        self.lengths = np.linalg.norm(queries, axis=1)
        # k strangers just below the floor stand for what was found elsewhere; they lose every tie.
        self.scores = np.repeat(np.where(np.isfinite(floors), floors - 0.5, -np.inf)[:, None], k, axis=1)
        self.ids = np.full(self.scores.shape, np.iinfo(np.int64).max)
        self.work = np.zeros(len(queries), np.int64)

    def run(self, tree: tuple[Page, np.ndarray, float]) -> None:
        page, centre, radius = tree
        at_centre = self.queries @ centre
        self.slack = SLACK * (1 + self.lengths * (float(np.linalg.norm(centre)) + radius))
        self.work += 1
        limits = at_centre + self.lengths * radius
        heap, turn = [(-float(limits.max()), 0, page, np.arange(len(self.queries)), at_centre, limits)], 1
        while heap:
            _, _, page, rows, at_parent, limits = heapq.heappop(heap)
            open_now = limits + self.slack[rows] >= self.scores[rows, -1]
            rows, at_parent = rows[open_now], at_parent[open_now]
            if not len(rows):
                continue
            floor = (self.scores[rows, -1] - self.slack[rows] - at_parent) / np.maximum(self.lengths[rows], 1e-300)
            reach = page.parent + page.radii
            hopeful = np.flatnonzero(reach >= floor.min())
            some = floor <= reach.max()
            rows = rows[some]
            products = self.queries[rows] @ page.centres[hopeful].T
            self.work[rows] += len(hopeful)
            if page.children is None:
                self._keep(rows, products, page.ids[hopeful])
                continue
            limits = products + self.lengths[rows, None] * page.radii[hopeful]
            serves = limits + self.slack[rows, None] >= self.scores[rows, -1][:, None]
            for at, child in enumerate(hopeful.tolist()):
                own = serves[:, at]
                if own.any():
                    entry = (-float(limits[own, at].max()), turn, page.children[child], rows[own], products[own, at], limits[own, at])
                    heapq.heappush(heap, entry)
                    turn += 1

    def _keep(self, rows: np.ndarray, products: np.ndarray, ids: np.ndarray) -> None:
        products = np.where(ids == self.owns[rows, None], -np.inf, products)
        better = np.flatnonzero((products >= self.scores[rows, -1][:, None]).any(axis=1) & np.isfinite(products).any(axis=1))
        if not len(better):
            return
        rows = rows[better]
        scores = np.concatenate([self.scores[rows], products[better]], axis=1)
        both = np.concatenate([self.ids[rows], np.repeat(ids[None], len(rows), axis=0)], axis=1)
        order = np.lexsort((both, -scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, order, axis=1)
        self.ids[rows] = np.take_along_axis(both, order, axis=1)

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and of their hits among ``scores`` and ``ids``."""
        least = np.where(np.isfinite(self.floors), self.floors, -np.inf)
        return np.nonzero(np.isfinite(self.scores) & (self.scores >= least[:, None]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: int = 256, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score (and ``products``, those of the query's search): the ``k`` vectors with the
    highest integer inner product for each row of ``queries``, ties to the smaller id; rows with the
    query's own id are no candidates. All candidates, if there are fewer. Ids that repeat are
    candidates each; of queries that repeat one the smallest vector asks. Shorter vectors count as filled up with zeros.

    Every vector goes to the nearest of some centres and, by a digest, to a shard of at most about
    ``shard_rows`` there, so equal vectors of any number are spread. A shard is an M-tree of its
    own. A query first searches one shard of its own centre; what it finds there bounds it in all
    others, and only shards whose centre and radius can still beat the bound are searched. Queries go to a shard in
    blocks; a block holds at most about QUERY_BLOCK of them.
    """
    session = vectors.sparkSession
    rows = cut_lineage(whole_vectors(vectors, id, vector, scale))
    asked = cut_lineage(whole_vectors(queries, id, vector, scale).groupBy("id").agg(F.min("v").alias("v")))
    measured = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size")).first()
    total, size = measured["n"], max(measured["size"] or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    shard_rows = max(shard_rows, -(-total // MOST_SHARDS))
    shards = max(1, -(-total // shard_rows))
    digest = F.xxhash64("id", F.lit(3))
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    sample = rows.where(F.pmod(digest, F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("v").limit(2 * SAMPLE_ROWS)
    spread = np.unique(_matrix(sample.toArrow().column("v"), size), axis=0)
    picked = np.random.default_rng(2).permutation(len(spread))[: max(1, min(shards, 1024))]
    middles = spread[picked] if len(spread) else np.zeros((1, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = _matrix(batch.column(1), size)
            near = ((middles**2).sum(1) - 2 * lines @ middles.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["id", "v", "cell"])

    fields = "id bigint, v array<bigint>, cell int"
    placed = cut_lineage(rows.mapInArrow(place, fields))
    cells = placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    cells = F.broadcast(cells)  # a row for each centre, 1024 at most
    shard = F.concat_ws("/", "cell", F.pmod(F.xxhash64("id"), F.col("parts")))
    members = cut_lineage(placed.join(cells, "cell").select("id", "v", shard.alias("shard")))

    def measure(group: pd.DataFrame) -> pd.DataFrame:
        lines = _lines(group["v"], size)
        centre = lines.mean(axis=0)
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "centre": [centre.tolist()], "radius": [float(np.linalg.norm(lines - centre, axis=1).max())]})

    directory = cut_lineage(members.groupBy("shard").applyInPandas(measure, "shard string, centre array<double>, radius double"))

    def search(key, found: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(asking):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "products": []}, dtype=np.int64)
        tree = build_tree(_lines(found["v"], size), found["id"].to_numpy(np.int64))
        owns = asking["id"].to_numpy(np.int64)
        floors = asking["floor"].to_numpy(np.float64)
        searched = Search(_lines(asking["v"], size), owns, k, np.where(np.isfinite(floors), floors, -np.inf))
        searched.run(tree)
        at, place = searched.found()
        return pd.DataFrame(
            {"query_id": owns[at], "vec_id": searched.ids[at, place], "score": searched.scores[at, place].astype(np.int64), "products": searched.work[at]}
        )

    def run(asking: DataFrame) -> DataFrame:
        """``asking``: id, v, floor, shard, written. Vectors go where queries for their shard are, once a block."""
        blocks = asking.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        blocks = cut_lineage(blocks)
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        asking = asking.join(blocks, "shard").select("shard", block.alias("block"), "id", "v", "floor")
        copies = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        held = members.join(blocks, "shard").select("shard", copies.alias("block"), "id", "v")
        pair = held.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block"))
        return pair.applyInPandas(search, "query_id bigint, vec_id bigint, score bigint, products bigint")

    homes = asked.mapInArrow(place, fields).join(cells, "cell", "left")
    home = F.concat_ws("/", "cell", F.pmod(F.xxhash64("id", F.lit(5)), F.coalesce("parts", F.lit(1))))
    homes = homes.select("id", "v", F.lit(float("nan")).alias("floor"), home.alias("shard"))
    first = cut_lineage(run(cut_lineage(homes)))
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floor = F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(float("-inf"))
    waiting = homes.select("id", "v", "shard").join(floors, homes["id"] == floors["query_id"], "left")
    waiting = waiting.select("id", "v", F.col("shard").alias("home"), F.coalesce(floor, F.lit(float("-inf"))).alias("floor"))
    known = [(r["shard"], r["centre"], r["radius"]) for r in directory.toLocalIterator()]
    listed = session.sparkContext.broadcast(([s for s, _, _ in known], np.array([c for _, c, _ in known]).reshape(len(known), size), np.array([r for _, _, r in known])))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres, radii = listed.value
        for batch in batches:
            lines, homes = _matrix(batch.column(1), size), batch.column(2).to_pylist()
            floors = batch.column(3).to_numpy()
            lengths = np.linalg.norm(lines, axis=1)
            limits = lines @ centres.T + lengths[:, None] * radii
            slack = SLACK * (1 + np.abs(limits))
            for i in range(0, batch.num_rows, 256):
                at, shard = np.nonzero(limits[i : i + 256] + slack[i : i + 256] >= floors[i : i + 256, None])
                at += i
                other = np.array([names[s] != homes[q] for q, s in zip(at.tolist(), shard.tolist(), strict=True)], bool)
                at, shard = at[other], shard[other]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(floors[at]), pa.array([names[s] for s in shard.tolist()], pa.string())], names=["id", "v", "floor", "shard"])

    second = run(cut_lineage(waiting.mapInArrow(choose, "id bigint, v array<bigint>, floor double, shard string")))
    found = first.unionByName(second)
    # k rows a query and shard at most; kept as the k best by partial sums, so none meet in one task.
    entry = F.struct((-F.col("score")).alias("less"), "vec_id")
    best = found.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("all"), F.sum("products").alias("products"))
    ranked = best.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("at", "hit"), "products")
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"), "products")


def _lines(column: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(column), size), np.float64)
    for line, values in zip(out, column, strict=True):
        line[: len(values)] = values
    return out
