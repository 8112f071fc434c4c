"""Hard negatives by segment summaries: bounds on inner products from stored means and deviations, refined level by level.

Every vector is stored with the mean and the deviation of each of its finest segments (runs of neighbouring components).
For one segment of length L the part of the inner product lies within L * mean_a * mean_b plus or minus
L * deviation_a * deviation_b; the sum over segments bounds the whole. Coarser segments follow from the stored ones, so a
pair is bounded first by one segment, then by 2, 4, ... up to the finest, and only pairs that no level rules out are scored
exactly, in integers.

Two searches use this. An anchor's positives are its best rows of its own label: a pair goes as soon as its upper bound is
below the fifth best score found. Its negatives lie in a window of scores for each positive: a pair goes as soon as its
bounds miss all windows, or its upper bound is below what every window already holds. Ties never go: bounds are taken a
little wide and compared strictly.

Anchors form the query set. They are dealt into groups of bounded size, all rows into parts of bounded size, by hash, so
neither a label nor an id can crowd a task. Every (group, part) is one task, which gives back at most a few rows per anchor;
the rest is a window over these. What is shuffled is all rows once per group of anchors.

Defined cases: rows without an id, label or vector, and rows with a missing or non-finite component, take no part; vectors
of different lengths never meet; vectors without components score 0; rows with equal ids are rows of their own, and ties
between them are broken by the place in the input; scores beyond 64 bits are held at its ends; an empty table gives no rows;
other columns never take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.session import materialised

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
SEGMENTS = 16  # finest segments of a stored vector
PART_ROWS, GROUP_ANCHORS = 16_384, 4_096
PART_BYTES = 16_000_000  # at most this much of vectors in a part, in a group of anchors half of it
TILE = 1 << 21  # numbers of a dense matrix held at once
EXACT = float(1 << 53)


# --- stored rows ---------------------------------------------------------------------------------------------------


def cuts(length: int, segments: int = SEGMENTS) -> np.ndarray:
    """Ends of the finest segments: as many as a power of two up to `segments` allows, near equal in length."""
    count = 1
    while 2 * count <= min(segments, max(1, length)):
        count *= 2
    return np.arange(count + 1) * length // count


def summaries(vectors: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each finest segment, row by row."""
    ends = cuts(vectors.shape[1], segments)
    mean = np.zeros((len(vectors), len(ends) - 1))
    deviation = np.zeros_like(mean)
    for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if hi > lo:
            part = vectors[:, lo:hi]
            mean[:, k] = part.mean(axis=1)
            deviation[:, k] = np.sqrt(((part - mean[:, k : k + 1]) ** 2).mean(axis=1))
    return mean, deviation


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str, relabelled: int | None, labels: int) -> DataFrame:
    """Rows that take part: place, id, label, and components of 256 steps to one as floating-point whole numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("raw"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND raw IS NOT NULL").where(F.forall("raw", finite))
    if relabelled:
        moved = (F.col("label") + 1) % labels
        rows = rows.withColumn("label", F.when(F.col("id") % relabelled == 0, moved).otherwise(F.col("label")))
    return rows.withColumn("row", F.monotonically_increasing_id())


def stored(rows: DataFrame) -> DataFrame:
    """Rows with their vector and segment summaries packed for comparison, written once."""

    def pack(batches):
        for batch in batches:
            size = np.array(batch.column("raw").value_lengths().to_numpy(zero_copy_only=False), np.int64)
            flat = batch.column("raw").flatten().to_numpy(zero_copy_only=False)
            whole = np.floor(256.0 * flat)
            ends = np.cumsum(size)
            vector, summary = [b""] * len(size), [b""] * len(size)
            for length in np.unique(size):
                at = np.flatnonzero(size == length)
                own = whole[(ends[at] - length)[:, None] + np.arange(length)]
                small = np.abs(own).max(axis=1, initial=0) < 1 << 15
                both = np.concatenate(summaries(own), axis=1).astype("<f4")
                for i, v, s, narrow in zip(at.tolist(), own, both, small.tolist(), strict=True):
                    vector[i] = v.astype("<i2" if narrow else "<f8").tobytes()
                    summary[i] = s.tobytes()
            columns = [batch.column(c) for c in ("row", "id", "label")] + [pa.array(size.astype(np.int32)), pa.array(vector, pa.binary()), pa.array(summary, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "label", "length", "vector", "summary"])

    packed = rows.select("row", "id", "label", "raw").mapInArrow(pack, "row long, id long, label long, length int, vector binary, summary binary")
    return materialised(packed, "vectors")


class Side:
    """Rows of one length as matrices, with the summaries of all levels."""

    def __init__(self, table: pa.Table, length: int):
        self.row, self.id, self.label = (table.column(c).to_numpy() for c in ("row", "id", "label"))
        self.vectors = np.zeros((len(self.row), length))
        for i, raw in enumerate(table.column("vector").to_pylist()):
            self.vectors[i] = np.frombuffer(raw, "<i2" if len(raw) == 2 * length else "<f8")
        ends = cuts(length)
        fine = np.frombuffer(b"".join(table.column("summary").to_pylist()), "<f4").reshape(len(self.row), 2, len(ends) - 1).astype(float)
        size, mean, square = np.diff(ends).astype(float), fine[:, 0], fine[:, 1] ** 2
        self.levels = [(size, mean, np.sqrt(square))]
        while len(size) > 1:
            both = size[::2] + size[1::2]
            whole = np.maximum(both, 1)
            centre = (size[::2] * mean[:, ::2] + size[1::2] * mean[:, 1::2]) / whole
            square = (size[::2] * (square[:, ::2] + (mean[:, ::2] - centre) ** 2) + size[1::2] * (square[:, 1::2] + (mean[:, 1::2] - centre) ** 2)) / whole
            size, mean = both, centre
            self.levels.insert(0, (size, mean, np.sqrt(square)))
        self.norm = np.sqrt((self.vectors**2).sum(axis=1))
        self.most = float(np.abs(self.vectors).max(initial=0))


class Pairs:
    """Pairs (anchor, row) of one tile that are still possible, all of them until a level has ruled out most."""

    def __init__(self, a: Side, lo: int, hi: int, b: Side, allowed: np.ndarray):
        self.a, self.lo, self.hi, self.b, self.allowed, self.places = a, lo, hi, b, allowed, None

    def _sparse(self) -> None:
        if self.places is None and self.allowed.mean() < 0.1:
            self.places = np.nonzero(self.allowed)

    def refine(self, rules_out) -> None:
        """Go down the levels; `rules_out(anchors, low, high)` tells which pairs are impossible by their bounds."""
        a, b = self.a, self.b
        for (size, mean_a, dev_a), (_, mean_b, dev_b) in zip(a.levels, b.levels, strict=True):
            self._sparse()
            if self.places is None:
                middle = (mean_a[self.lo : self.hi] * size) @ mean_b.T
                reach = (dev_a[self.lo : self.hi] * size) @ dev_b.T
                slack = 1e-5 * a.norm[self.lo : self.hi, None] * b.norm[None, :] + 0.5
                self.allowed &= ~rules_out(np.arange(self.hi - self.lo)[:, None], middle - reach - slack, middle + reach + slack)
            else:
                i, j = self.places
                if not len(i):
                    return
                middle = np.einsum("ps,ps->p", mean_a[self.lo + i] * size, mean_b[j])
                reach = np.einsum("ps,ps->p", dev_a[self.lo + i] * size, dev_b[j])
                slack = 1e-5 * a.norm[self.lo + i] * b.norm[j] + 0.5
                keep = ~rules_out(i, middle - reach - slack, middle + reach + slack)
                self.places = i[keep], j[keep]

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and exact inner product of the pairs left."""
        a, b = self.a, self.b
        self._sparse()
        dense = self.places is None
        i, j = np.nonzero(self.allowed) if dense else self.places
        length = a.vectors.shape[1]
        if length * a.most * b.most < EXACT:
            if dense:
                score = (a.vectors[self.lo : self.hi] @ b.vectors.T)[i, j]
            else:
                score = np.zeros(len(i))
                for at in range(0, len(i), step := max(1, TILE // max(1, length))):
                    cut = slice(at, at + step)
                    score[cut] = np.einsum("pd,pd->p", a.vectors[self.lo + i[cut]], b.vectors[j[cut]])
            return i, j, score.astype(np.int64)
        exact = [sum(int(x) * int(y) for x, y in zip(a.vectors[self.lo + p], b.vectors[q], strict=True)) for p, q in zip(i, j, strict=True)]
        ends = np.iinfo(np.int64)
        return i, j, np.array([min(max(s, ends.min), ends.max) for s in exact], np.int64)


def best(owner: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best entries of every owner: highest score, then smallest id, then row; sorted so."""
    order = np.lexsort((row, id_, -score, owner))
    first = np.searchsorted(owner[order], owner[order], side="left")
    return order[np.arange(len(order)) - first < most]


class Found:
    """The best entries of every owner so far, and the score that a new one has to reach."""

    def __init__(self, owners: int, most: int, least: np.ndarray):
        self.most, self.least = most, least.astype(float)
        self.owner, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, owner: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        self.owner, self.score, self.id, self.row = (
            np.concatenate([old, new]) for old, new in ((self.owner, owner), (self.score, score), (self.id, id_), (self.row, row))
        )
        keep = best(self.owner, self.score, self.id, self.row, self.most)
        self.owner, self.score, self.id, self.row = self.owner[keep], self.score[keep], self.id[keep], self.row[keep]
        full = np.flatnonzero(np.arange(len(keep)) - np.searchsorted(self.owner, self.owner) == self.most - 1)
        at = self.owner[full]
        self.least[at] = np.maximum(self.least[at], self.score[full])


def tiles(anchors: Side, rows: Side):
    step = max(1, TILE // max(1, len(rows.row)))
    for lo in range(0, len(anchors.row), step):
        yield lo, min(len(anchors.row), lo + step)


def sides(anchors: pa.Table, rows: pa.Table):
    """Both tables as matrices, length by length."""
    own, other = anchors.column("length").to_numpy(), rows.column("length").to_numpy()
    for length in np.unique(own):
        a, b = anchors.filter(pa.array(own == length)), rows.filter(pa.array(other == length))
        if b.num_rows:
            yield a, Side(a, int(length)), Side(b, int(length))


def part_positives(anchors: pa.Table, rows: pa.Table, most: int) -> dict[str, np.ndarray]:
    """Best rows of the anchors' own labels in one part."""
    out = []
    for _, a, b in sides(anchors, rows):
        found = Found(len(a.row), most, np.full(len(a.row), -np.inf))
        for lo, hi in tiles(a, b):
            allowed = (a.label[lo:hi, None] == b.label[None, :]) & (a.row[lo:hi, None] != b.row[None, :])
            pairs = Pairs(a, lo, hi, b, allowed)
            least = found.least[lo:hi]
            pairs.refine(lambda i, low, high, least=least: high < least[i])
            i, j, score = pairs.scores()
            found.add(lo + i, score, b.id[j], b.row[j])
        out.append((a.row[found.owner], a.id[found.owner], found.row, found.id, found.score))
    return columns(out, ("anchor_row", "anchor_id", "row", "id", "score"))


def part_negatives(anchors: pa.Table, rows: pa.Table, most: int, low_percent: int, high_percent: int) -> dict[str, np.ndarray]:
    """Best rows of other labels within the window of each positive's score in one part."""
    out = []
    for table, a, b in sides(anchors, rows):
        lists = table.column("scores").to_pylist()
        width = max(map(len, lists))
        known = np.zeros((len(a.row), width), bool)
        floor, ceiling = np.zeros((len(a.row), width), np.int64), np.zeros((len(a.row), width), np.int64)
        for i, scores in enumerate(lists):
            for k, p in enumerate(scores):
                low, high = -(-low_percent * p // 100), high_percent * p // 100
                known[i, k], floor[i, k], ceiling[i, k] = low <= high, low, high
        found = Found(len(a.row) * width, most, np.where(known, floor, np.inf).reshape(-1))
        for lo, hi in tiles(a, b):
            pairs = Pairs(a, lo, hi, b, a.label[lo:hi, None] != b.label[None, :])
            least = np.where(known, found.least.reshape(-1, width), np.inf)[lo:hi].min(axis=1)
            highest = np.where(known, ceiling, -np.inf)[lo:hi].max(axis=1)
            pairs.refine(lambda i, low, high, least=least, highest=highest: (high < least[i]) | (low > highest[i]))
            i, j, score = pairs.scores()
            for k in range(width):
                ok = known[lo + i, k] & (score >= floor[lo + i, k]) & (score <= ceiling[lo + i, k])
                found.add((lo + i[ok]) * width + k, score[ok], b.id[j[ok]], b.row[j[ok]])
        at, place = found.owner // width, found.owner % width
        out.append((a.row[at], place, found.row, found.id, found.score))
    return columns(out, ("anchor_row", "place", "row", "id", "score"))


def columns(parts: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([p[k] for p in parts] or [np.zeros(0)]).astype(np.int64) for k, n in enumerate(names)}


# --- jobs ----------------------------------------------------------------------------------------------------------


def dealt(anchors: DataFrame, rows: DataFrame, groups: int, parts: int) -> tuple:
    """Anchors and rows grouped by (group, part): every anchor in each part, every row in each group."""
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (anchors, rows))  # both come from one table
    left = left.withColumn("group", deal(groups)).withColumn("part", every(parts))
    right = right.withColumn("part", deal(parts)).withColumn("group", every(groups))
    return left.groupBy("group", "part"), right.groupBy("group", "part")


def ranked(found: DataFrame, by: list[str], most: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)


def hard_negatives(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    anchor: Column | None = None,
    relabelled: int | None = None,
    labels: int = 10,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW,
    high_percent: int = HIGH,
    part_rows: int = PART_ROWS,
    group_anchors: int = GROUP_ANCHORS,
) -> DataFrame:
    """One row per anchor, positive and negative, best negative first.

    `anchor` is a condition on `id` and `label` that picks the query set (every row without it). `relabelled` moves the label of
    rows whose id it divides to the next of `labels` ones, as noise to be found.
    """
    rows = stored(usable(vectors, vec_id, vector, label, relabelled, labels))
    chosen = rows if anchor is None else rows.where(anchor)
    n, widest = rows.agg(F.count(F.lit(1)), F.max(F.length("vector"))).first()
    n_anchors = chosen.count()
    fit = max(1, PART_BYTES // max(1, 8 * (widest or 1)))
    parts = max(1, -(-n // min(part_rows, fit)))
    groups = max(1, -(-n_anchors // min(group_anchors, max(1, fit // 2))))

    def near(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table(part_positives(a, b, positives))

    def far(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table(part_negatives(a, b, negatives, low_percent, high_percent))

    a, b = dealt(chosen, rows, groups, parts)
    found = a.cogroup(b).applyInArrow(near, "anchor_row long, anchor_id long, row long, id long, score long")
    mine = materialised(ranked(found, ["anchor_row"], positives, "place").withColumn("place", F.col("place") - 1), "positives")
    scores = mine.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))
    a, b = dealt(chosen.join(scores.withColumnRenamed("anchor_row", "row"), "row"), rows, groups, parts)
    found = a.cogroup(b).applyInArrow(far, "anchor_row long, place long, row long, id long, score long")
    top = ranked(found, ["anchor_row", "place"], negatives, "rank")
    top = top.select("anchor_row", F.col("place").cast("int").alias("place"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = mine.select("anchor_row", "anchor_id", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return top.join(known, ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


# The same search by comparing every anchor with every row; ids are taken to be unique.
NEGATIVES_SQL = """
WITH raw AS (
    SELECT CAST(vec_id AS BIGINT) AS id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), rows AS (SELECT id, CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM raw),
pairs AS (
    SELECT a.id AS anchor_id, b.id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON len(a.v) = len(b.v) AND a.id <> b.id
    WHERE a.id % 50 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), negatives AS (
    SELECT p.anchor_id, p.positive_id, q.id AS negative_id, p.positive_score, q.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY q.score DESC, q.id) AS INTEGER) AS rank
    FROM positives p JOIN pairs q ON p.anchor_id = q.anchor_id AND NOT q.alike
    WHERE 50 * positive_score <= 100 * q.score AND 100 * q.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
