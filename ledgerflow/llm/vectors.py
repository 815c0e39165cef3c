"""Operator 2: near copies among embeddings by a robust-pruned graph over overlapping cluster shards."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import mixed, share_of
from .components import components

THRESHOLD = 0.95
SAMPLE = 20_000  # vectors that the centroids are fitted on, about
CENTROIDS = 1024  # at most
SHARD = 2000  # vectors per centroid, about
OVERLAP = 3  # shards that each vector lies in
CELL = 6000  # vectors of a shard that one graph holds
DEGREE = 16  # out-edges that pruning leaves
POOL = 48  # nearest vectors from which edges are chosen
FAR = 16  # vectors anywhere in the cell from which long edges are chosen
ALPHA = 1.2
BEAM = 16
AUDIT = 200  # vectors whose links are counted by brute force, about
RECALL = 0.99  # below this the index is made anew with twice the overlap
SALTS = 16  # parts that the vectors of one id are dealt to


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    rows = np.zeros((len(column), width))
    for at, value in enumerate(column):
        v = np.frombuffer(value.as_py(), np.float64)
        rows[at, : len(v)] = v
    return rows


def centroids_of(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means."""
    order = np.argsort(mixed(np.arange(len(sample), dtype=np.uint64)))
    centers = sample[order[:count]].copy()
    for _ in range(rounds):
        near = (sample @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centers)
    return centers


def robust_pruned(vectors: np.ndarray, pool: np.ndarray, rows: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges of the rows, chosen from their pools nearest first; -1 fills up.

    A candidate is passed over once a chosen one is nearer to it, by the factor
    alpha, than the row is.
    """
    to = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nld->nl", vectors[rows], vectors[pool]), 0))
    order = np.argsort(to, axis=1, kind="stable")
    pool, to = np.take_along_axis(pool, order, 1), np.take_along_axis(to, order, 1)
    points = vectors[pool]
    among = np.sqrt(np.maximum(2 - 2 * np.einsum("nad,nbd->nab", points, points), 0))
    alive = pool != rows[:, None]
    each = np.arange(len(rows))
    edges = np.full((len(rows), degree), -1)
    for step in range(degree):
        best = alive.argmax(axis=1)
        some = alive[each, best]
        edges[some, step] = pool[some, best[some]]
        alive &= ~(some[:, None] & (alpha * among[each, best] <= to))
        alive[each, best] = False
    return edges


def graph(vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust-pruned out-edges of all rows, from near ones and some far ones."""
    n = len(vectors)
    pool_size = min(POOL, n - 1)
    edges = np.full((n, degree), -1)
    if n < 2:
        return edges
    far = (mixed(np.arange(n * FAR, dtype=np.uint64)) % np.uint64(n)).astype(np.int64).reshape(n, FAR)
    for start in range(0, n, 256):
        rows = np.arange(start, min(start + 256, n))
        near = vectors[rows] @ vectors.T
        near[np.arange(len(rows)), rows] = -2
        top = np.argpartition(-near, pool_size - 1, axis=1)[:, :pool_size]
        edges[rows] = robust_pruned(vectors, np.hstack([top, far[rows]]), rows, degree, alpha)
    return edges


def both_ways(edges: np.ndarray) -> list[np.ndarray]:
    """Each row's edges and those that lead to it, so that no row is left without a way in."""
    n, degree = edges.shape
    of, to = np.repeat(np.arange(n), degree), edges.ravel()
    of, to = of[to >= 0], to[to >= 0]
    pair = np.unique(np.concatenate([of * n + to, to * n + of]))
    return np.split(pair % n, np.searchsorted(pair // n, np.arange(1, n)))


class Cell:
    """The graph over one cell's vectors, searched for blocks of queries at once."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lists: list[np.ndarray]):
        self.ids, self.vectors = ids, vectors
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.heads = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(lists).astype(np.int64)
        center = vectors.mean(axis=0)
        self.medoid = int((vectors @ center).argmax())

    def expand(self, queries: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of (query, node) pairs."""
        number = self.sizes[nodes]
        place = np.repeat(self.heads[nodes] - (np.cumsum(number) - number), number) + np.arange(number.sum())
        return np.repeat(queries, number), self.flat[place]

    def seen_new(self, seen: np.ndarray, queries: np.ndarray, nodes: np.ndarray, vectors: np.ndarray):
        """Of the (query, node) pairs those not seen before, once each, with their similarity; they are seen from now on."""
        fresh = (nodes >= 0) & ~seen[queries, np.maximum(nodes, 0)]
        pair = np.unique(queries[fresh] * len(self.ids) + nodes[fresh])
        queries, nodes = pair // len(self.ids), pair % len(self.ids)
        seen[queries, nodes] = True
        near = np.empty(len(pair))
        for at in range(0, len(pair), 1 << 16):
            part = slice(at, at + (1 << 16))
            near[part] = np.einsum("nd,nd->n", vectors[queries[part]], self.vectors[nodes[part]])
        return queries, nodes, near

    def within(self, vectors: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) found with a similarity from ``threshold`` on.

        Best-first search from the medoid, and from a query's own node where the
        cell has it, fills a beam; then the search is widened to the range: as
        long as nodes within it, or a little outside, have not been expanded,
        they are, whatever their number.
        """
        n, number = len(self.ids), len(vectors)
        seen = np.zeros((number, n), bool)
        every = np.arange(number)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        beam = np.full((number, BEAM), -1)
        value = np.full((number, BEAM), -np.inf)
        open_ = np.zeros((number, BEAM), bool)
        near_range: list[tuple[np.ndarray, np.ndarray]] = []
        slack = threshold - 0.05

        def add(queries, nodes):
            nonlocal beam, value, open_
            queries, nodes, near = self.seen_new(seen, queries, nodes, vectors)
            hit = near >= threshold
            found.append((queries[hit], nodes[hit]))
            close = near >= slack
            near_range.append((queries[close], nodes[close]))
            # The best of the old beam and the new nodes, for each query that got some.
            order = np.lexsort((-near, queries))
            queries, nodes, near = queries[order], nodes[order], near[order]
            rank = np.arange(len(queries)) - np.searchsorted(queries, queries)
            top = rank < BEAM
            queries, nodes, near, rank = queries[top], nodes[top], near[top], rank[top]
            got = np.unique(queries)
            place = np.searchsorted(got, queries)
            extra, extra_value = np.full((len(got), BEAM), -1), np.full((len(got), BEAM), -np.inf)
            extra[place, rank], extra_value[place, rank] = nodes, near
            all_value = np.hstack([value[got], extra_value])
            best = np.argsort(-all_value, axis=1, kind="stable")[:, :BEAM]
            beam[got] = np.take_along_axis(np.hstack([beam[got], extra]), best, 1)
            open_[got] = np.take_along_axis(np.hstack([open_[got], extra >= 0]), best, 1)
            value[got] = np.take_along_axis(all_value, best, 1)

        add(np.concatenate([every, every]), np.concatenate([np.full(number, self.medoid), own]))
        expanded = np.zeros((number, n), bool)
        while True:
            score = np.where(open_, value, -np.inf)
            pick = score.argmax(axis=1)
            some = np.flatnonzero(open_[every, pick])
            if not len(some):
                break
            nodes = beam[some, pick[some]]
            open_[some, pick[some]] = False
            expanded[some, nodes] = True
            add(*self.expand(some, nodes))
        while near_range:
            queries, nodes = (np.concatenate(x) for x in zip(*near_range))
            near_range.clear()
            left = ~expanded[queries, nodes]
            queries, nodes = queries[left], nodes[left]
            expanded[queries, nodes] = True
            for at in range(0, len(queries), 1 << 14):
                part = slice(at, at + (1 << 14))
                asked, reached, near = self.seen_new(seen, *self.expand(queries[part], nodes[part]), vectors)
                hit, close = near >= threshold, near >= slack
                found.append((asked[hit], reached[hit]))
                if close.any():
                    near_range.append((asked[close], reached[close]))
        queries, nodes = (np.concatenate(x) for x in zip(*found))
        return queries, nodes


class NearVectors:
    """Links vectors by cosine; see :func:`near_vectors`."""

    def __init__(self, threshold: float = THRESHOLD, shard: int = SHARD, overlap: int = OVERLAP, cell: int = CELL):
        self.threshold, self.shard, self.overlap, self.cell = threshold, shard, overlap, cell

    def classes(self, rows: DataFrame) -> DataFrame:
        """``(vec_id, v)``: each id's distinct unit vectors as bytes of doubles; only those that may link."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, units = [], []
                for key, value in zip(batch.column("vec_id"), batch.column("embedding")):
                    v = np.array(value.values.to_numpy(zero_copy_only=False), np.float64) if value.is_valid else np.zeros(0)
                    # Scaled first, so that no square overflows or vanishes.
                    top = np.abs(v).max() if len(v) else 0.0
                    if key.is_valid and top > 0 and np.isfinite(v).all():
                        v = v / top
                        ids.append(key.as_py())
                        units.append((v / np.sqrt(v @ v)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(units, pa.binary())], ["vec_id", "v"])

        return rows.mapInArrow(run, "vec_id long, v binary").distinct()

    def named(self, known: DataFrame) -> tuple[DataFrame, bool]:
        """``known`` with a ``name`` for each row, and whether any id has several vectors.

        An id with one vector is its name; the vectors of an id with several get
        numbers beyond all ids.
        """
        several = durable(known.groupBy("vec_id").count().where("count > 1").select("vec_id"), "several")
        if several.isEmpty():
            return known.withColumn("name", F.col("vec_id")), False
        top = known.agg(F.max("vec_id")).first()[0]
        # An id may have a third of all vectors, so its rows are spread.
        marks = several.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("again"))
        told = known.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(marks, ["vec_id", "salt"], "left")
        told = told.withColumn("number", F.monotonically_increasing_id())
        name = F.when(F.col("again"), F.lit(top) + 1 + F.col("number")).otherwise(F.col("vec_id"))
        return durable(told.select("vec_id", "v", name.alias("name")), "names"), True

    def placed(self, nodes: DataFrame, centers: np.ndarray, overlap: int) -> DataFrame:
        """``(id, v, copies, shards)``: each node with its nearest centroids."""
        width, take = centers.shape[1], min(overlap, len(centers))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = unit_rows(batch.column("v"), width) @ centers.T
                top = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :take], axis=1)
                yield batch.append_column("shards", pa.array(top.tolist(), pa.list_(pa.int32())))

        return nodes.mapInArrow(run, "id long, v binary, copies long, shards array<int>")

    def linked(self, nodes: DataFrame, centers: np.ndarray, overlap: int) -> DataFrame:
        """``(id, links, root)``: for each node and cell, links that the cell owns and the least id joined to it there."""
        width, threshold = centers.shape[1], self.threshold
        placed = durable(self.placed(nodes, centers, overlap), "placed")
        spread = placed.withColumn("shard", F.explode("shards"))
        parts = spread.groupBy("shard").agg(F.ceil(F.count("*") / self.cell).cast("int").alias("parts"))
        # At most one line for each centroid.
        spread = spread.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

        def build(table: pa.Table) -> pa.Table:
            ids = table.column("id").to_numpy()
            order = np.argsort(ids)
            ids = ids[order]
            lists = both_ways(graph(unit_rows(table.column("v").combine_chunks().take(pa.array(order)), width)))
            return pa.table([pa.array(ids), pa.array([ids[e].tolist() for e in lists], pa.list_(pa.int64()))], ["id", "edges"])

        built = spread.select("shard", "part", "id", "v").groupBy("shard", "part").applyInArrow(build, "id long, edges array<long>")
        # The union of a node's lists: some 2 * DEGREE for each shard it lies in.
        union = durable(built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")), "graph")
        full = spread.join(union, "id")
        numbers = F.sequence(F.lit(0), F.col("parts") - 1)
        # Each block of queries of a shard meets each of its cells; both are bounded.
        targets = full.select("shard", F.explode(numbers).alias("asks"), F.col("part").alias("of"), "id", "v", "copies", "shards", "edges", F.lit(True).alias("target"))
        queries = spread.select("shard", F.col("part").alias("asks"), F.explode(numbers).alias("of"), "id", "v", "copies", "shards", F.lit(None).cast("array<long>").alias("edges"), F.lit(False).alias("target"))

        def search(table: pa.Table) -> pa.Table:
            shard = table.column("shard")[0].as_py()
            target = table.column("target").to_numpy()
            table = table.take(pa.array(np.lexsort((table.column("id").to_numpy(), ~target))))
            size = int(target.sum())
            ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
            vectors = unit_rows(table.column("v").combine_chunks(), width)
            homes = np.array(table.column("shards").to_pylist())
            lists = table.column("edges").slice(0, size).to_pylist()
            near = []
            for wide in lists:
                at = np.searchsorted(ids[:size], wide)
                near.append(at[ids[np.minimum(at, size - 1)] == wide])
            root = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            links = {}
            asked = np.arange(size, len(ids))
            cell = Cell(ids[:size], vectors[:size], near) if size else None
            for start in range(0, len(asked) if size else 0, 256):
                rows = asked[start : start + 256]
                own = np.searchsorted(ids[:size], ids[rows])
                own = np.where((own < size) & (ids[np.minimum(own, size - 1)] == ids[rows]), own, -1)
                queries, nodes = cell.within(vectors[rows], own, threshold)
                other = ids[rows[queries]] != ids[nodes]
                queries, nodes = rows[queries[other]], nodes[other]
                # A pair that shares several shards belongs to the first.
                a, b = homes[queries][:, :, None], homes[nodes][:, None, :]
                first = np.where((a == b).any(axis=2), homes[queries], np.iinfo(np.int64).max).min(axis=1)
                mine = first == shard
                np_links = np.bincount(queries[mine] - rows[0], copies[nodes[mine]], minlength=len(rows))
                for row, number in zip(rows, np_links):
                    links[int(ids[row])] = int(number)
                order = np.argsort(queries, kind="stable")
                for x, y in zip(ids[queries[order]].tolist(), ids[nodes[order]].tolist()):
                    p, q = find(x), find(y)
                    if p != q:
                        root[max(p, q)] = min(p, q)
            keys = sorted(set(links) | set(root))
            return pa.table(
                [pa.array(keys, pa.int64()), pa.array([links.get(k, 0) for k in keys], pa.int64()), pa.array([find(k) for k in keys], pa.int64())],
                ["id", "links", "root"],
            )

        both = targets.union(queries)
        return both.groupBy("shard", "asks", "of").applyInArrow(search, "id long, links long, root long")

    def recall(self, nodes: DataFrame, found: DataFrame, width: int, total: int) -> float:
        """Of about ``AUDIT`` nodes, the mean share of a node's true links (by brute force over all rows) that were found; 1 if none has any."""
        asked = nodes.where(share_of("id", "copies") < min(1.0, AUDIT / max(total, 1))).select("id", "v").toArrow()
        if not asked.num_rows:
            return 1.0
        ids, queries = asked.column("id").to_numpy(), unit_rows(asked.column("v").combine_chunks(), width)
        threshold = self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = queries @ unit_rows(batch.column("v"), width).T >= threshold
                hit &= ids[:, None] != batch.column("id").to_numpy()
                number = (hit * batch.column("copies").to_numpy()).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(number.astype(np.int64))], ["id", "true"])

        true = nodes.mapInArrow(run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
        told = true.where(F.col("true") > 0).join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
        # Each node counts alike, so a large group does not hide what small ones lose.
        share = told.agg(F.avg(F.least("true", F.coalesce("links", F.lit(0))) / F.col("true"))).first()[0]
        return 1.0 if share is None else float(share)

    def grouped(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        known, several = self.named(durable(self.classes(rows), "vectors"))
        # Equal vectors are one node with a count and the least of their names.
        nodes = durable(known.groupBy("v").agg(F.min("name").alias("id"), F.count("*").alias("copies")).select("id", "v", "copies"), "nodes")
        size = nodes.agg(F.count("*").alias("n"), F.max(F.length("v")).alias("w")).first()
        ids = rows.select("vec_id")
        if not size.n:
            return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("audit_recall"))
        width, overlap = size.w // 8, self.overlap
        sample = nodes.where(share_of("id") < min(1.0, SAMPLE / size.n)).select("v").toArrow()
        count = min(CENTROIDS, -(-size.n // self.shard), max(1, sample.num_rows))
        centers = centroids_of(unit_rows(sample.column("v").combine_chunks(), width), count) if sample.num_rows else np.zeros((1, width))
        while True:
            found = durable(self.linked(nodes, centers, overlap), "found")
            recall = self.recall(nodes, found, width, size.n)
            if recall >= RECALL or overlap >= len(centers):
                break
            overlap *= 2
        if recall < 0.9:
            warnings.warn(f"audited recall is {recall:.3f}", stacklevel=2)
        edges = found.select(F.col("id").alias("a"), F.col("root").alias("b"))
        if several:
            # An id joins all of its vectors; it is less than any number given to them.
            own = known.where("name <> vec_id").select("vec_id", "v").join(nodes.select("id", "v"), "v")
            edges = edges.union(own.select("id", "vec_id"))
        joined = durable(components(edges), "components")
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        told = nodes.join(links, "id", "left").join(joined, "id", "left").select(
            "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("c")
        )
        each = known.join(told, "v").select("vec_id", "n", "c")
        if several:
            each = each.groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("c").alias("c"))
        out = ids.join(each, "vec_id", "left")
        component = F.coalesce("c", "vec_id")
        return out.select(
            "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
            F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).alias("audit_recall"),
        )


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, **options: int) -> DataFrame:
    """``(vec_id, n_links, component_id, kept, audit_recall)`` of each row.

    Vectors (``embedding``, an array of numbers) are linked from a cosine of
    ``threshold`` on, in double precision. Those that are NULL, empty, zero or
    hold a NULL or non-finite number link with nothing; shorter ones count as
    filled up with zeros. Rows that repeat a vec_id get that id's result: an id
    with several distinct vectors has the links of all of them (one for each other
    pair of id and vector, its own included) and joins what they reach; ids must
    then lie below 2**62. Rows without an id link with nothing. The component is
    the least id reachable, and that row is kept. Other columns are ignored.

    Equal vectors become one node. Centroids, fitted on a bounded sample, deal
    every node to the nearest ``overlap`` shards; a shard that is too large is
    cut into cells. A robust-pruned graph is built in each cell, a node's lists
    of all its cells are united, and each node is searched for in its shards.
    Links are counted where they are found, so no pairs leave a task. About 200
    nodes are audited against all rows; if on average less than 99 % of a linked
    node's links were found, the index is made anew with twice the overlap.
    """
    return NearVectors(threshold, **options).grouped(rows)
