"""MinHash near-duplicates with an LSH forest, links confirmed on full shingle sets.

Texts with equal shingle sets become one node first, so a text with a third of all rows is one node. Every node gets
`ORDERS` sort keys, each a different arrangement of its signature, and every order is sorted as a whole by a range
exchange, which may cut anywhere and so knows no hot keys. A node's candidates are its next neighbours in each order as
long as the keys agree in the first `MIN_DEPTH` components: where few texts are alike, neighbours share just that; where
many are, the sort puts those with the longest common prefix side by side, so the depth adapts to each region and a group
of any size gives a few candidates per member.

The orders come in waves. After each wave its candidates are confirmed and linked, and the next wave's rows carry the label
of their component, so neighbours that earlier waves have joined make no pairs: a large group of copies costs a few pairs
per member and not some for every order.

Candidates are confirmed on full sets in rounds. A pair inside a component that earlier rounds have linked cannot change
the result and is skipped; the pairs left are tested, the most similar first, until none joins two components untested.

Neighbours alone lose members of a crowded run, one of more rows with equal first components than a window spans: an
original whose many copies do not link with each other is the neighbour of a few of them. So every run that is longer than
a window, or that a partition border may cut, and that still holds several components is compared whole: its rows are cut
into blocks of bounded size, and all pairs of blocks are tested on full sets, except for pairs of nodes that are in one
component already. A task returns links of components, fewer than it has components, never pairs. This work grows with the
square of a run, but only where the run is not linked by its neighbours.

Recall: two texts of similarity s agree in the first four components of some order with probability
1 - (1 - s^4)^24, which is 0.999997 at 0.8, if components are independent, and all pairs that agree so are compared. The
estimate drops a neighbour pair at the threshold with a probability below 1e-6, so the whole chain finds 0.999996 of them.

Defined cases: a text without words, or a missing one, has no shingles and links with nothing; one with fewer words than
a shingle takes is one shingle; rows with equal ids are judged by their own texts, so an id with several texts may have
several components, and links of one do not join those of another; a row without an id links with nothing, has no component
and is kept; an empty table gives no rows; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import shuffle_partitions
from tallyfield.llm.components import connected_components
from tallyfield.session import materialised

ORDERS, MIN_DEPTH, DEPTH, NEIGHBOURS = 24, 4, 12, 3
COMPONENTS = ORDERS * MIN_DEPTH
MAX_WORDS = 300_000
ESTIMATE_LOSS = 1e-6  # chance that the estimate drops a pair at the threshold; the orders miss 3.2e-6 at 0.8
TESTS_PER_ROUND = (1, 4)
WAVES = ((0, 2), (2, 8), (8, ORDERS))  # first and last order of each wave
BROADCAST_IDS = 2_000_000  # 16 MB of ids
BLOCK_NODES, BLOCK_BYTES = 512, 2_000_000

_RANDOM = np.random.default_rng(20240229)
_A = (_RANDOM.integers(0, 1 << 32, COMPONENTS, dtype=np.uint64) | 1).astype(np.uint32)
_B = _RANDOM.integers(0, 1 << 32, COMPONENTS, dtype=np.uint64).astype(np.uint32)
# Order t starts with four components that no other order starts with and goes on with others.
_ORDER = np.stack([np.concatenate([np.arange(COMPONENTS), np.arange(COMPONENTS)])[MIN_DEPTH * t :][:MIN_DEPTH] for t in range(ORDERS)])
_REST = np.stack([_RANDOM.permutation(np.setdiff1d(np.arange(COMPONENTS), row))[: DEPTH - MIN_DEPTH] for row in _ORDER])
_ORDER = np.concatenate([_ORDER, _REST], axis=1)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound; one per task, so that it does not outlive its stage."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < MAX_WORDS:
            self[word] = value
        return value


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; words are lower-cased in A-Z and cut at ASCII white space."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, n)
    width = min(words, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k]
    acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(acc ^ (acc >> np.uint64(32)))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(COMPONENTS, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, (x[at : at + 512, None] * _A + _B).min(axis=0), out=low)
    return low


def signatures(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """Set size, set fingerprint and signature of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            size, print_, sig = [], [], []
            for body in batch.column(1).to_pylist():
                s = shingle_set(body, words, hashes)
                size.append(len(s))
                mixed = (s ^ (s >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                print_.append(np.array([s.sum(), mixed.sum()], np.uint64).tobytes() if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(print_, pa.binary()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "print", "sig"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, print binary, sig binary")


def order_keys(nodes: DataFrame, first: int = 0, last: int = ORDERS) -> DataFrame:
    """A row per node and order: the order's number, its sort key of 16 bits per component, the node and its component."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, COMPONENTS)
            keys = (sig >> np.uint32(16)).astype(">u2")[:, _ORDER[first:last]]  # node, order, component
            flat = np.ascontiguousarray(keys).view(f"S{2 * DEPTH}").reshape(-1)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * DEPTH), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())
            order = pa.array(np.tile(np.arange(first, last, dtype=np.int32), n))
            node, component = (pa.array(np.repeat(batch.column(k).to_numpy(), last - first)) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([order, raw, node, component], names=["order", "key", "node", "component"])

    return nodes.select("node", "sig", "component").mapInArrow(spread, "order int, key binary, node long, component long")


def order_heads(nodes: DataFrame) -> DataFrame:
    """A row per node and order: the first components of its sort key as one number."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, COMPONENTS)
            order = pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), n))
            node = pa.array(np.repeat(batch.column(0).to_numpy(), ORDERS))
            yield pa.RecordBatch.from_arrays([order, pa.array(_heads(sig).reshape(-1)), node], names=["order", "head", "node"])

    return nodes.select("node", "sig").mapInArrow(spread, "order int, head long, node long")


def _heads(sig: np.ndarray) -> np.ndarray:
    """The first components of every order, node by order."""
    keys = (sig >> np.uint32(16)).astype(">u2")[:, _ORDER[:, :MIN_DEPTH]]
    return np.ascontiguousarray(keys).view(np.int64)[:, :, 0]


def neighbour_pairs(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs of neighbours of two components whose keys agree in the first signature components, and the runs not covered.

    Those (`order`, `head`) have more rows than a window spans, or stand at a border of a partition, which may cut them.
    """
    head, back = 2 * MIN_DEPTH, NEIGHBOURS + 1

    def rows(pairs: np.ndarray, order: np.ndarray, prefix: np.ndarray) -> pa.RecordBatch:
        ends = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(len(order), pa.int64())]) for x in pairs]  # of nodes and components
        run = [pa.concat_arrays([pa.nulls(pairs.shape[1], k), pa.array(x, k)]) for x, k in ((order, pa.int32()), (prefix, pa.int64()))]
        return pa.RecordBatch.from_arrays([*ends, *run], names=["a", "b", "component_a", "component_b", "order", "head"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, prefix, node, own = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        none, first = np.zeros((4, 0), np.int64), True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fixed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, 2 * DEPTH)
            order = np.concatenate([order, batch.column(0).to_numpy()])
            prefix = np.concatenate([prefix, np.ascontiguousarray(fixed[:, :head]).view(np.int64).reshape(-1)])
            node = np.concatenate([node, batch.column(2).to_numpy()])
            own = np.concatenate([own, batch.column(3).to_numpy()])
            held, found = len(node) - n, []
            for step in range(1, NEIGHBOURS + 1):
                later = np.arange(max(step, held), len(node))
                earlier = later - step
                ok = (order[later] == order[earlier]) & (prefix[later] == prefix[earlier]) & (own[later] != own[earlier])
                later, earlier = later[ok], earlier[ok]
                swap = node[later] < node[earlier]
                low, high = np.where(swap, later, earlier), np.where(swap, earlier, later)
                found.append(np.stack([node[low], node[high], own[low], own[high]]))
            unique = np.unique(np.concatenate(found, axis=1), axis=1)
            later = np.arange(max(back, held), len(node))
            later = later[(order[later] == order[later - back]) & (prefix[later] == prefix[later - back])]
            later = later[(np.diff(prefix[later], prepend=~prefix[later[:1]]) != 0) | (np.diff(order[later], prepend=-1) != 0)]
            later = np.concatenate([np.zeros(int(first), np.int64), later])
            yield rows(unique, order[later], prefix[later])
            order, prefix, node, own, first = order[-back:], prefix[-back:], node[-back:], own[-back:], False
        yield rows(none, order[-1:], prefix[-1:])

    parts = shuffle_partitions(keys.sparkSession)
    sorted_ = keys.repartitionByRange(parts, "order", "key", "node").sortWithinPartitions("order", "key", "node")
    schema = "a long, b long, component_a long, component_b long, order int, head long"
    found = materialised(sorted_.mapInArrow(pairs, schema), "neighbours")
    runs = found.where("order IS NOT NULL").select("order", "head").distinct()
    return found.where("order IS NULL").select("a", "b", "component_a", "component_b").distinct(), materialised(runs, "runs")


_ENDS = ("a", "b", "component_a", "component_b")


def _two_sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs with the given columns of both ends, suffixed _a and _b."""
    for end in ("a", "b"):
        side = table.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = pairs.join(side, end)
    return pairs


def least_equal(threshold: float) -> int:
    """Equal components that a pair at the threshold falls short of with a probability of `ESTIMATE_LOSS` at most."""
    below = accumulate(comb(COMPONENTS, k) * threshold**k * (1 - threshold) ** (COMPONENTS - k) for k in range(COMPONENTS))
    return sum(p <= ESTIMATE_LOSS for p in below)


def estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose signatures do not rule the threshold out, with the number of equal components."""
    least = least_equal(threshold)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(n, COMPONENTS) for k in (4, 5))
            same = (x == y).sum(axis=1).astype(np.int32)
            ok = same >= least
            columns = [batch.column(k).filter(pa.array(ok)) for k in range(4)] + [pa.array(same[ok])]
            yield pa.RecordBatch.from_arrays(columns, names=[*_ENDS, "same"])

    both = _two_sides(pairs, nodes, "sig").select(*_ENDS, "sig_a", "sig_b")
    return both.mapInArrow(estimate, "a long, b long, component_a long, component_b long, same int")


def shingle_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, words: int) -> DataFrame:
    """Full sets of the documents named in `wanted`."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_set(body, words, hashes).tobytes() for body in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "members"])

    # Up to a counted size the ids go to the texts; beyond it the texts are shuffled to the ids.
    wanted = materialised(wanted, "wanted")
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("body")).join(near, "node", "left_semi")
    return rows.mapInArrow(sets, "node long, members binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components of the pairs whose full sets reach the threshold: 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["component_a", "component_b"])

    both = _two_sides(pairs, sets, "members").select("component_a", "component_b", "members_a", "members_b")
    return both.mapInArrow(confirm, "component_a long, component_b long")


def linked_components(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`component`, `into` for the components of the candidates after the links that full sets confirm.

    `candidates` has the ends `a`, `b`, their components and `same`. Round after round, the pairs that still join two
    components are tested, the best ones of each component first, all of them in the end.
    """
    crossing = candidates.select(*_ENDS, "same")
    labels = crossing.select(F.col("component_a").alias("component")).union(crossing.select("component_b")).distinct()
    labels = labels.select("component", F.col("component").alias("into"))
    for tests in (*TESTS_PER_ROUND, None):
        chosen = crossing
        if tests is not None:
            sides = [crossing.select(*_ENDS, "same", F.col(f"component_{e}").alias("component")) for e in ("a", "b")]
            best = Window.partitionBy("component").orderBy(F.desc("same"), "a", "b")
            ranked = sides[0].union(sides[1]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= tests)
            chosen = materialised(ranked.select(*_ENDS).distinct(), "chosen")
        links = confirmed(chosen, sets, percent)
        merged = materialised(connected_components(links, "component_a", "component_b"), "merged")
        over = merged.select(F.col("node").alias("into"), F.col("component").alias("next"))
        labels = labels.join(over, "into", "left").select("component", F.coalesce("next", "into").alias("into"))
        labels = materialised(labels, "labels")
        if tests is None:
            break
        left = crossing.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
        for end in ("a", "b"):
            side = merged.select(F.col("node").alias(f"component_{end}"), F.col("component").alias("next"))
            left = left.join(side, f"component_{end}", "left").withColumn(f"component_{end}", F.coalesce("next", f"component_{end}")).drop("next")
        crossing = materialised(left.where("component_a <> component_b").select(*_ENDS, "same"), "crossing")
        if crossing.isEmpty():
            break
    return labels


def waves(docs: DataFrame, doc_id: str, text: str, nodes: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Components of all nodes (`node`, `component`) after all orders, and the runs that neighbours do not cover."""
    labels, runs = nodes.select("node", F.col("node").alias("component")), None
    for first, last in WAVES:
        pairs, more = neighbour_pairs(order_keys(nodes.join(labels, "node"), first, last))
        runs = more if runs is None else runs.union(more)
        candidates = materialised(estimated(pairs, nodes, percent / 100), "candidates")
        if candidates.isEmpty():
            continue
        wanted = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct()
        sets = materialised(shingle_sets(docs, doc_id, text, wanted, words), "sets")
        over = linked_components(candidates, sets, percent)
        labels = labels.join(over, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
        labels = materialised(labels, "labels")
    return labels, runs


def mixed_runs(nodes: DataFrame, runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (`order`, `head`, `node`, `component`) of the runs that hold several components."""
    near = F.broadcast(runs) if runs.count() <= BROADCAST_IDS else runs
    rows = order_heads(nodes).join(near, ["order", "head"], "left_semi").distinct().join(labels, "node", "left")
    rows = materialised(rows.select("order", "head", "node", F.coalesce("component", "node").alias("component")), "run-rows")
    mixed = rows.groupBy("order", "head").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    mixed = materialised(mixed.select("order", "head"), "mixed")
    return rows.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_IDS else mixed, ["order", "head"], "left_semi")


_PACKED = ("components", "sizes", "sigs", "members")


def run_blocks(rows: DataFrame) -> DataFrame:
    """Rows with sets and signatures packed into blocks of one run, of bounded length and size; `low` and `high` components."""
    names = ["order", "head", "block", "low", "high", *_PACKED]
    kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 4]

    def packed(held: list[tuple], block: int) -> tuple:
        order, head, components, sigs, members = zip(*held, strict=True)
        sizes = np.array([len(m) // 8 for m in members], np.int64)
        own = np.array(components, np.int64)
        return order[0], head[0], block, int(own.min()), int(own.max()), own.tobytes(), sizes.tobytes(), b"".join(sigs), b"".join(members)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, weight = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            full = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                size = len(row[-1])
                if held and (row[:2] != held[0][:2] or len(held) == BLOCK_NODES or weight + size > BLOCK_BYTES):
                    full.append(packed(held, block))
                    block, held, weight = block + 1, [], 0
                held.append(row)
                weight += size
            if full:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*full, strict=True), kinds, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(packed(held, block), kinds, strict=True)], names=names)

    by = ["order", "head", "component", "node"]
    sorted_ = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    schema = "order int, head long, block long, low long, high long, components binary, sizes binary, sigs binary, members binary"
    return sorted_.select("order", "head", "component", "sig", "members").mapInArrow(gather, schema)


def block_links(order: int, x: list[np.ndarray], y: list[np.ndarray], same: bool, percent: int) -> list[tuple[int, int]]:
    """Links of components by the pairs of two blocks (components, sizes, signatures, sets), each link joining two that no earlier one has joined.

    Pairs that agree in the head of an earlier order are left to it.
    """
    (own_x, size_x, sig_x, set_x), (own_y, size_y, sig_y, set_y) = x, y
    head_x, head_y = (_heads(sig.reshape(-1, COMPONENTS))[:, :order] for sig in (sig_x, sig_y))
    names, local = np.unique(np.concatenate([own_x, own_y]), return_inverse=True)
    at_x, at_y, joined = local[: len(own_x)], local[len(own_x) :], np.arange(len(names))
    known, place_y = np.unique(set_y, return_inverse=True)
    place_x = np.minimum(np.searchsorted(known, set_x), len(known) - 1)
    place_x = np.where(known[place_x] == set_x, place_x, len(known))
    ends, starts = np.cumsum(size_x), np.cumsum(size_y) - size_y
    flags, links = np.zeros(len(known) + 1, bool), []
    for i in range(len(own_x)):
        ok = (joined[at_y] != joined[at_x[i]]) & (100 * np.minimum(size_y, size_x[i]) >= percent * np.maximum(size_y, size_x[i]))
        if same:
            ok[: i + 1] = False
        ok[ok] = ~(head_y[ok] == head_x[i]).any(axis=1)
        if not ok.any():
            continue
        mine = place_x[ends[i] - size_x[i] : ends[i]]
        flags[mine] = True
        flags[-1] = False
        both = np.add.reduceat(flags[place_y], starts, dtype=np.int64)
        flags[mine] = False
        for j in np.flatnonzero(ok & (100 * both >= percent * (size_x[i] + size_y - both))):
            p, q = joined[at_x[i]], joined[at_y[j]]
            if p != q:
                joined[joined == q] = p
                links.append((int(own_x[i]), int(own_y[j])))
    return links


def run_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (`component_a`, `component_b`) between the components of a run, from all pairs of its blocks."""
    kinds = [np.int64, np.int64, np.uint32, np.uint64]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for order, same, *sides in zip(*batch.columns, strict=True):
                x, y = ([np.frombuffer(v.as_buffer(), k) for v, k in zip(side, kinds, strict=True)] for side in (sides[:4], sides[4:]))
                links += block_links(order.as_py(), x, y, same.as_py(), percent)
            ends = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["component_a", "component_b"])

    a, b = (blocks.select("order", "head", *[F.col(c).alias(f"{c}_{e}") for c in ("block", "low", "high")]) for e in ("a", "b"))
    pairs = a.join(b, ["order", "head"]).where("block_a <= block_b AND least(low_a, low_b) < greatest(high_a, high_b)")
    pairs = pairs.select("order", "block_a", "block_b").repartition(shuffle_partitions(blocks.sparkSession), "block_a", "block_b")
    columns = []
    for end in ("a", "b"):
        named = [f"{c}_{end}" for c in _PACKED]
        side = blocks.select(F.col("block").alias(f"block_{end}"), *[F.col(c).alias(n) for c, n in zip(_PACKED, named, strict=True)])
        pairs, columns = pairs.join(side, f"block_{end}"), columns + named
    return pairs.select("order", F.expr("block_a = block_b").alias("same"), *columns).mapInArrow(compare, "component_a long, component_b long")


def whole_runs(docs: DataFrame, doc_id: str, text: str, nodes: DataFrame, runs: DataFrame, labels: DataFrame, words: int, percent: int) -> DataFrame:
    """Components after all pairs of the given runs that are in different ones are tested on full sets."""
    rows = materialised(mixed_runs(nodes, runs, labels), "mixed-rows")
    if rows.isEmpty():
        return labels
    sets = shingle_sets(docs, doc_id, text, rows.select("node").distinct(), words).where("length(members) > 0")
    blocks = materialised(run_blocks(rows.join(sets, "node").join(nodes, "node")), "blocks")
    over = connected_components(run_links(blocks, percent), "component_a", "component_b")
    over = over.select(F.col("node").alias("component"), F.col("component").alias("into"))
    labels = nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return materialised(labels.join(over, "component", "left").select("node", F.coalesce("into", "component").alias("component")), "labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: `n_shingles`, `component_id` (smallest id that links reach) and `kept`."""
    signed = materialised(signatures(docs, doc_id, text, words), "signatures")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    prints = materialised(usable.groupBy("print").agg(F.min("doc_id").alias("node")), "prints")
    nodes = usable.join(prints, "print").where(F.col("doc_id") == F.col("node")).dropDuplicates(["print"]).select("node", "sig")
    nodes = materialised(nodes, "nodes")
    labels, runs = waves(docs, doc_id, text, nodes, words, percent)
    labels = whole_runs(docs, doc_id, text, nodes, runs, labels, words, percent)
    classes = materialised(prints.join(labels, "node", "left").select("print", F.coalesce("component", "node").alias("component")), "classes")
    found = signed.select("doc_id", "n_shingles", "print").join(classes, "print", "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest id, with all columns as they are.

    Of several rows with one id that stays, the one with the smallest text hash is kept; rows without an id all stay.
    """
    found = near_duplicates(docs, doc_id, text, words, percent)
    ids = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept_id")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = row.where(F.col(f"row.`{doc_id}`").isNotNull()).join(ids, F.col(f"row.`{doc_id}`").cast("long") == F.col("__kept_id"))
    one = Window.partitionBy("__kept_id").orderBy(F.xxhash64(F.col(f"row.`{text}`")))
    named = named.withColumn("n", F.row_number().over(one)).where("n = 1").select("row")
    return named.union(row.where(F.col(f"row.`{doc_id}`").isNull())).select("row.*")
