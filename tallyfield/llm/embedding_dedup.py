"""Exact threshold links between embeddings by a dual traversal of cover trees.

Equal vectors become one node with a count. The top of the tree is a bounded set of pivots from a bounded sample; every
pivot has a tight cell and one for what lies farther away. Cells are cut into strips of bounded size, pairs of cells that
no link can join are pruned by their measured covering radii, and a tight cell whose diameter lies within the threshold
counts as linked throughout, so a group of near copies with a third of all rows is never compared within itself.

Strips are written once to the shared folder, a file each, and a task reads those it compares, so that no vector is sent
once per partner: disk grows with the vectors alone. A task takes one strip and a run of its partners, builds the lower
trees (nested levels with halving radii) and walks two trees at once. A pair of tree nodes is dropped if its centres are farther apart than both covering radii
and the threshold, taken as linked as a whole if the farthest members are near enough, and opened otherwise; only
leaves are compared one by one, in double precision. What a task gives back is linear in its strips: partial link counts
and one root per linked member.

In many dimensions unrelated vectors are all about equally far apart, so no bound separates cells of such vectors, and
the number of strip pairs then grows with the square of the number of strips, at one matrix product each.

Defined cases: vectors that are missing, empty, zero or hold missing or non-finite parts link with nothing, and so do
vectors of different lengths; rows with equal vectors link with each other, also if their ids are equal; a row without an
id links with nothing, has no component and is kept; an empty table gives no rows; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import shuffle_partitions
from tallyfield.llm.components import connected_components
from tallyfield.llm.token_planes import place
from tallyfield.session import materialised, work_path

SAMPLE = 4096
MAX_PIVOTS = 256
STRIP = 8192
RUN = 64  # partners of a strip that one task compares it with, at most
TIGHT = 0.2
RADII = (0.5, 0.25, 0.125, 0.0625)
BLOCK = 2_000_000  # numbers held at once per matrix while trees are walked
ROUNDING = 1e-5  # bounds are taken this much wider, as centres are compared in single precision


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chords between unit rows."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def covered_by(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the number of its centre; centres are picked in order, each point that no earlier one covers."""
    near = 1 - radius * radius / 2
    centre, picked = np.zeros(len(points), np.int64), []
    for at in range(0, len(points), 512):
        block = points[at : at + 512]
        own = np.full(len(block), -1, np.int64)
        if picked:
            s = block @ points[picked].T
            best = s.argmax(axis=1)
            hit = s[np.arange(len(block)), best] >= near
            own[hit] = np.asarray(picked)[best[hit]]
        within = block @ block.T >= near
        for i in np.flatnonzero(own < 0).tolist():
            if own[i] < 0:
                picked.append(at + i)
                own[within[i] & (own < 0)] = at + i
                own[i] = at + i
        centre[at : at + 512] = own
    return centre


class CoverTree:
    """Nested levels over the rows of a matrix; `order` lists rows so that every node's members are a range."""

    def __init__(self, points: np.ndarray):
        self.points = points
        single = points.astype(np.float32)
        self.order: list[int] = []
        self.centre, self.start, self.end, self.radius, self.children = [], [], [], [], []
        self.roots = self._level(single, np.arange(len(points)), 0)
        self.order = np.asarray(self.order, np.int64)
        self.centre, self.start, self.end = (np.asarray(x, np.int64) for x in (self.centre, self.start, self.end))
        self.radius = np.asarray(self.radius)

    def _level(self, single: np.ndarray, members: np.ndarray, level: int) -> list[int]:
        nodes = []
        if level < len(RADII) and len(members) > 1:
            group = covered_by(single[members], RADII[level])
        else:
            group = np.arange(len(members))
        ordered = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[ordered], prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ordered)], strict=True):
            own = members[ordered[lo:hi]]  # the centre is the first of its members
            node = len(self.centre)
            nodes.append(node)
            self.centre.append(int(own[0]))
            self.start.append(len(self.order))
            self.end.append(len(self.order) + len(own))
            self.radius.append(0.0)
            self.children.append([])
            if len(own) == 1:
                self.order.append(int(own[0]))
                continue
            self.radius[node] = float(distances(self.points[own], self.points[own[:1]]).max())
            self.children[node] = self._level(single, own, level + 1)
        return nodes


class Traversal:
    """Links between the members of two trees, or within one if both are the same."""

    def __init__(self, a: CoverTree, b: CoverTree, copies_a: np.ndarray, copies_b: np.ndarray, cosine: float):
        self.a, self.b, self.same, self.cosine = a, b, a is b, cosine
        self.reach = np.sqrt(2 - 2 * cosine)
        self.sum_a = np.concatenate([[0], np.cumsum(copies_a[a.order])])
        self.sum_b = np.concatenate([[0], np.cumsum(copies_b[b.order])])
        self.gain_a, self.gain_b = np.zeros(len(a.order) + 1, np.int64), np.zeros(len(b.order) + 1, np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.whole_a: set[int] = set()
        self.whole_b: set[int] = set()
        self.inner: list[int] = []  # nodes of the one tree whose members all link with each other
        self.run()

    def run(self) -> None:
        a, b = self.a, self.b
        ra, rb = np.asarray(a.roots), np.asarray(b.roots)
        # Roots u, v may hold links if 1 - u.v <= (p + q)^2 / 2 with p, q their radii and the threshold; as one product of wider rows.
        p, q, one = a.radius[ra] + self.reach + ROUNDING, b.radius[rb], np.ones
        ca = np.column_stack([a.points[a.centre[ra]], p, p * p / 2, one(len(ra))]).astype(np.float32)
        cb = np.column_stack([b.points[b.centre[rb]], q, one(len(rb)), q * q / 2]).astype(np.float32).T
        rows, most = max(1, BLOCK // len(rb)), max(1, BLOCK // a.points.shape[1])
        for at in range(0, len(ra), rows):
            i, j = np.divmod(np.flatnonzero(ca[at : at + rows] @ cb >= np.float32(1 - ROUNDING)), len(rb))
            left = [np.stack([ra[at + i], rb[j]])]
            if self.same:
                left = [left[0][:, left[0][0] <= left[0][1]]]
            while left:  # depth first, a bounded number of pairs at a time
                pairs = left.pop()
                if pairs.shape[1] > most:
                    left.append(pairs[:, most:])
                opened = self.step(*pairs[:, :most])
                if opened.shape[1]:
                    left.append(opened)

    def step(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Drop, count or open each pair of nodes; the pairs of opened nodes come back."""
        a, b = self.a, self.b
        p, q = a.points[a.centre[x]], b.points[b.centre[y]]
        cos = (p * q).sum(axis=1)
        d = np.sqrt(np.maximum(0, 2 - 2 * cos))
        rx, ry = a.radius[x], b.radius[y]
        itself = (x == y) & self.same
        leaf = (a.end[x] - a.start[x] == 1) & (b.end[y] - b.start[y] == 1)
        linked = np.where(leaf, cos >= self.cosine, d + rx + ry <= self.reach - 1e-9) & ~(leaf & itself)
        self.count(x[linked], y[linked])
        open_ = ~linked & ~leaf & (d <= rx + ry + self.reach + 1e-9)
        out: list[tuple[int, int]] = []
        for i, j in zip(x[open_].tolist(), y[open_].tolist(), strict=True):
            if self.same and i == j:
                c = a.children[i]
                out += [(u, v) for k, u in enumerate(c) for v in c[k:]]
            elif not b.children[j] or (a.children[i] and a.radius[i] >= b.radius[j]):
                out += [(u, j) if not self.same or u <= j else (j, u) for u in a.children[i]]
            else:
                out += [(i, v) if not self.same or i <= v else (v, i) for v in b.children[j]]
        return np.array(out, np.int64).reshape(-1, 2).T

    def count(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b = self.a, self.b
        own = (x == y) & self.same
        wa, wb = self.sum_a[a.end[x]] - self.sum_a[a.start[x]], self.sum_b[b.end[y]] - self.sum_b[b.start[y]]
        np.add.at(self.gain_a, a.start[x], wb)
        np.add.at(self.gain_a, a.end[x], -wb)
        np.add.at(self.gain_b, b.start[y], np.where(own, 0, wa))
        np.add.at(self.gain_b, b.end[y], -np.where(own, 0, wa))
        self.inner += x[own].tolist()
        self.edges.append((a.centre[x], b.centre[y]))
        self.whole_a.update(x.tolist())
        self.whole_b.update(y.tolist())

    def result(self, copies_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Link counts of both sides' members, and a label per member (the second side after the first)."""
        a, b = self.a, self.b
        la, lb = np.zeros(len(a.order), np.int64), np.zeros(len(b.order), np.int64)
        la[a.order], lb[b.order] = np.cumsum(self.gain_a)[:-1], np.cumsum(self.gain_b)[:-1]
        for node in self.inner:  # a member is no partner of its own
            rows = a.order[a.start[node] : a.end[node]]
            la[rows] -= copies_a[rows]
        shift = 0 if self.same else len(a.order)
        left = [e[0] for e in self.edges]
        right = [e[1] + shift for e in self.edges]
        for tree, whole, by in ((a, self.whole_a, 0), (b, self.whole_b, shift)):
            for node in whole:
                rows = tree.order[tree.start[node] : tree.end[node]]
                if len(rows) > 1:
                    left.append(np.full(len(rows), tree.centre[node]) + by)
                    right.append(rows + by)
        label = np.arange(shift + len(b.order))
        if left:
            u, v = np.concatenate(left), np.concatenate(right)
            while True:
                low = np.minimum(label[u], label[v])
                new = label.copy()
                np.minimum.at(new, u, low)
                np.minimum.at(new, v, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
        return la, lb, label


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def pick_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first from the first vector on."""
    chosen = [0]
    d = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(k, len(sample)):
        i = int(d.argmax())
        if d[i] <= TIGHT:
            break
        chosen.append(i)
        d = np.minimum(d, distances(sample, sample[i : i + 1])[:, 0])
    return sample[chosen]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def into_cells(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The nodes with their cell (two per pivot) and the distance to its centre."""

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = distances(unit_rows(matrix(batch.column(2))), pivots)
            near = d.argmin(axis=1)
            dist = d[np.arange(len(d)), near]
            cell = pa.array((2 * near + (dist > TIGHT)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, cell, pa.array(dist)], names=["node", "copies", "vector", "cell", "dist"])

    kind = dict(nodes.dtypes)["vector"]
    return nodes.select("node", "copies", "vector").mapInArrow(assign, f"node long, copies long, vector {kind}, cell int, dist double")


def _links_of_length(nodes: DataFrame, rows: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Partial counts (`node`, `links`) and edges (`a`, `b`) among vectors of one length."""
    spark = nodes.sparkSession
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").toArrow()
    pivots = pick_pivots(unit_rows(matrix(sample.column(0))), max(1, min(MAX_PIVOTS, -(-rows // STRIP))))
    placed = materialised(into_cells(nodes, pivots), "cells")
    stats = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.max("dist").alias("radius"), F.sum("copies").alias("copies"), F.min("node").alias("low")
    )
    cells = sorted(stats.collect(), key=lambda r: r["cell"])
    reach = float(np.sqrt(2 - 2 * cosine))
    between = distances(pivots, pivots)
    tight = {r["cell"] for r in cells if 2 * r["radius"] <= reach - 1e-9}
    strips, first = [], 0
    for r in cells:
        n = -(-r["rows"] // STRIP)
        strips.append((r["cell"], first, n, r["copies"], r["low"]))
        first += n
    table = F.broadcast(spark.createDataFrame(strips, "cell int, first int, strips int, in_cell long, low long"))
    partners = [
        (r["cell"], s["cell"])
        for i, r in enumerate(cells)
        for s in cells[i:]
        if (r is not s or r["cell"] not in tight) and between[r["cell"] // 2, s["cell"] // 2] <= r["radius"] + s["radius"] + reach + 1e-9
    ]
    inside = F.col("cell").isin(sorted(tight))
    whole = placed.join(table, "cell").where(inside)
    counts = whole.select("node", (F.col("in_cell") - F.col("copies")).alias("links"))
    edges = whole.select(F.col("node").alias("a"), F.col("low").alias("b"))
    if not partners:
        return counts, edges
    known = table.select(F.col("cell"), F.explode(F.sequence("first", F.col("first") + F.col("strips") - 1)).alias("strip"))
    cell_pairs = spark.createDataFrame(partners, "cell int, other int")
    ends = cell_pairs.join(known, "cell").withColumnRenamed("strip", "s").join(known.select(F.col("cell").alias("other"), F.col("strip").alias("t")), "other")
    ends = ends.where((F.col("cell") != F.col("other")) | (F.col("s") <= F.col("t"))).select("s", "t")
    members = placed.join(table, "cell").select(
        "node", "copies", "vector", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("strips"))).cast("int").alias("strip")
    )
    folder, stage = work_path(spark, "strips"), shuffle_partitions(spark)
    members.repartition(max(stage, min(2000, first)), "strip").write.partitionBy("strip").parquet(folder)

    def strip_of(strip: int) -> tuple[np.ndarray, np.ndarray, CoverTree] | None:
        system, root = place(f"{folder}/strip={strip}")
        files = sorted(f.path for f in system.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".parquet"))
        if not files:  # no node was dealt to it
            return None
        held = pa.concat_tables([pq.read_table(f, filesystem=system, partitioning=None) for f in files])
        return held.column("node").to_numpy(), held.column("copies").to_numpy(), CoverTree(unit_rows(matrix(held.column("vector"))))

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, run in ((s, run) for batch in batches for s, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            one = strip_of(s)
            for t in sorted(run) if one else []:
                two = one if s == t else strip_of(t)
                if not two:
                    continue
                (x, copies_x, a), (y, copies_y, b) = one, two
                la, lb, label = Traversal(a, b, copies_x, copies_y, cosine).result(copies_x)
                who, links = (x, la + lb) if s == t else (np.concatenate([x, y]), np.concatenate([la, lb]))
                hit = (links != 0) | (label != np.arange(len(label)))
                yield pa.RecordBatch.from_pydict({"node": who[hit], "links": links[hit], "root": who[label[hit]]})

    run = max(1, min(RUN, first * first // (16 * stage)))  # about eight runs or more for each of the stage's partitions
    runs = ends.groupBy("s", F.floor(F.col("t") / run).alias("run")).agg(F.collect_list("t").alias("t")).select("s", "t")
    runs = materialised(runs, "runs")
    dealt = runs.repartition(max(stage, min(2000, runs.count())))
    found = materialised(dealt.mapInArrow(traverse, "node long, links long, root long"), "found")
    return counts.union(found.select("node", "links")), edges.union(found.select(F.col("node").alias("a"), F.col("root").alias("b")))


def link_embeddings(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per vector: `n_links`, `component_id` (smallest id that links reach) and `kept`."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    good = rows.where(usable("vector") & F.col("vec_id").isNotNull())
    nodes = good.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = materialised(nodes, "vectors")
    lengths = {r["n"]: r["count"] for r in nodes.groupBy(F.size("vector").alias("n")).count().collect()}
    counts, edges = nodes.select("node", (F.col("copies") - 1).alias("links")), None
    for n, many in lengths.items():
        some = nodes if len(lengths) == 1 else nodes.where(F.size("vector") == n)
        more, ends = _links_of_length(some, many, cosine)
        counts, edges = counts.union(more), ends if edges is None else edges.union(ends)
    if edges is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    labels = connected_components(edges.where("a <> b"))
    totals = counts.groupBy("node").agg(F.sum("links").alias("links"))
    judged = nodes.select("vector", "node").join(totals, "node").join(labels, "node", "left")
    judged = materialised(judged.select("vector", "links", F.coalesce("component", "node").alias("component")), "judged")
    ours = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return rows.join(judged, "vector", "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        ours.alias("component_id"),
        F.coalesce(F.col("vec_id") == ours, F.lit(True)).alias("kept"),
    )


LINKS_SQL = """
WITH RECURSIVE units AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9
),
reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, r.low AS component_id, e.vec_id = r.low AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id
JOIN (SELECT vec_id, min(other) AS low FROM reach GROUP BY vec_id) r ON r.vec_id = e.vec_id
"""
