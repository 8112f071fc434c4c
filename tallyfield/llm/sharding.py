"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until the splitters are good enough.

The key is the hash of the text, then the hash of the document's id, so copies of a text lie next to each other, and a
text with a third of all rows can still be cut between its copies. Each round counts bytes and rows in at most
`CELLS` equal cells of every interval that still holds an open splitter; those counts, a bounded number, are all that
reaches the driver. Rows are exchanged once, when slots are dealt: within a shard the rows are numbered in groups that
are a key cell each, and several groups for a cell with more rows than its share, so no task sees a whole shard.

Defined cases: a missing text has size 8 and no checksum, a missing id hashes like any other value; repeated rows are
separate rows; rows that agree in text and id cannot be told apart by a splitter and stay in one shard, but their slots
are dealt in several groups, told apart by the row number they were written with; an empty table gives an empty result; other columns never take part (`shard_documents`) or are carried along (`write_shards`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import shuffle_partitions
from tallyfield.session import materialised

BITS = 12
CELLS = 1 << BITS
LOW, HIGH = -(1 << 63), 1 << 63
ROW_BYTES = 8


@dataclass
class Splitter:
    """Search for one boundary: bytes below `lo` in the current interval, and the result once it is good enough."""

    target: float
    prefix: tuple[int, ...] = ()
    lo: int = LOW
    bits: int = 64
    below: int = 0
    found: tuple[int, int] | None = field(default=None)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.col(text)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("h"),
        F.xxhash64(F.col(doc_id)).alias("d"),
        F.monotonically_increasing_id().alias("u"),
    )


def cells_of(key: Column, lo: int, bits: int) -> Column:
    """Number of the key's cell when the 2**bits keys from `lo` on are cut into equal cells."""
    if bits == 64:
        return F.shiftright(key, 64 - BITS) + (CELLS >> 1)
    return F.shiftright(key - F.lit(lo), max(0, bits - BITS))


def find_splitters(keys: DataFrame, shards: int, tolerance: float, group_tolerance: float) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Boundaries (text hash, id hash) between shards, and the rows of each cell of the first round.

    Cells are refined to `tolerance` of a shard or to a single row. A cell of copies of one text is cut only if the nearer
    of its ends misses the target by more than `group_tolerance`.
    """
    first = _histogram(keys, [Splitter(0)])[0]
    total = sum(b for b, _ in first.values())
    rows = {c: n for c, (_, n) in first.items()}
    share = total / shards
    open_ = [Splitter(share * k) for k in range(1, shards)]
    for s in open_:
        _narrow(s, first, tolerance * share, group_tolerance * share)
    while pending := [s for s in open_ if s.found is None]:
        for s, cells in zip(pending, _histogram(keys, pending), strict=True):
            _narrow(s, cells, tolerance * share, group_tolerance * share)
    return [s.found for s in open_], rows


def _histogram(keys: DataFrame, splitters: list[Splitter]) -> list[dict[int, tuple[int, int]]]:
    """Bytes and rows per cell of each splitter's interval, in one pass over the keys."""
    distinct = sorted({(s.prefix, s.lo, s.bits) for s in splitters})
    cases = []
    for i, (prefix, lo, bits) in enumerate(distinct):
        key = F.col("d") if prefix else F.col("h")
        inside = F.lit(True) if not prefix else F.col("h") == prefix[0]
        if bits < 64:
            inside = inside & key.between(lo, lo + (1 << bits) - 1)
        cases.append(F.when(inside, F.struct(F.lit(i).alias("i"), cells_of(key, lo, bits).cast("int").alias("c"))))
    found = (
        keys.select(F.explode(F.array_compact(F.array(*cases))).alias("cell"), "size")
        .groupBy("cell.i", "cell.c")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .collect()
    )
    per: list[dict[int, tuple[int, int]]] = [{} for _ in distinct]
    for r in found:
        per[r["i"]][r["c"]] = (r["bytes"], r["rows"])
    return [per[distinct.index((s.prefix, s.lo, s.bits))] for s in splitters]


def _narrow(s: Splitter, cells: dict[int, tuple[int, int]], tolerance: float, group_tolerance: float) -> None:
    """Go down to the cell in which the bytes reach the target, or settle on one of its ends."""
    step = max(0, s.bits - BITS)
    below = s.below
    for c in sorted(cells):
        size, rows = cells[c]
        if below + size < s.target:
            below += size
            continue
        start, end = s.lo + (c << step), s.lo + ((c + 1) << step)
        short, over = s.target - below, below + size - s.target
        one_text = step == 0 and not s.prefix
        good = min(short, over) <= (group_tolerance if one_text else tolerance)
        if good or rows == 1 or (step == 0 and s.prefix):
            edge = start if short <= over else end
            s.found = (s.prefix[0], edge) if s.prefix else (edge, LOW)
        elif step == 0:
            s.prefix, s.lo, s.bits, s.below = (start,), LOW, 64, below
        else:
            s.lo, s.bits, s.below = start, step, below
        return
    s.found = (s.prefix[0], HIGH) if s.prefix else (HIGH, LOW)


def shard_of(splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below the row's key."""
    number = F.lit(0)
    for h, d in splitters:
        above = F.col("h") > F.lit(min(h, HIGH - 1))
        if h < HIGH and d == LOW:
            above = F.col("h") >= F.lit(h)
        elif h < HIGH and d < HIGH:
            above = above | ((F.col("h") == F.lit(h)) & (F.col("d") >= F.lit(d)))
        number = number + above.cast("int")
    return number


def shard_documents(
    docs: DataFrame,
    shards: int = 24,
    doc_id: str = "doc_id",
    text: str = "text",
    tolerance: float = 0.001,
    group_tolerance: float = 0.005,
) -> DataFrame:
    """One row per document: size, checksum, shard and a gapless slot in it; sizes of shards are near equal.

    The tolerances are shares of a shard. Copies of a text stay in one shard unless that would cost more than
    `group_tolerance`.
    """
    spark = docs.sparkSession
    keys = materialised(keyed(docs, doc_id, text), "shard-keys")
    splitters, rows = find_splitters(keys, shards, tolerance, group_tolerance)
    most = max(1, sum(rows.values()) // (4 * shuffle_partitions(spark)))
    groups = spark.createDataFrame([(c, -(-n // most)) for c, n in rows.items()] or [(0, 1)], "cell int, groups int")
    dealt = (
        keys.withColumns({"shard": shard_of(splitters), "cell": cells_of(F.col("h"), LOW, 64).cast("int")})
        .join(F.broadcast(groups), "cell")
        .withColumn("part", F.pmod(F.xxhash64("d", "u"), F.col("groups")).cast("int"))
    )
    place = ["shard", "cell", "part"]
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*place).count().select(*place, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*place).orderBy("h", "d", "doc_id", "u")
    numbered = dealt.withColumn("at", F.row_number().over(inside))
    return numbered.join(starts, place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, doc_id: str = "doc_id", text: str = "text", max_records: int = 1_000_000) -> None:
    """Whole rows as Parquet below `path/shard=N`, cut by the same splitters; large shards become several files."""
    keys = materialised(keyed(docs, doc_id, text), "shard-keys")
    splitters, _ = find_splitters(keys, shards, 0.001, 0.005)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole = docs.select(row.alias("row"), F.xxhash64(F.col(text)).alias("h"), F.xxhash64(F.col(doc_id)).alias("d"))
    placed = whole.select("row.*", shard_of(splitters).alias("__shard")).withColumnRenamed("__shard", "shard")
    placed.hint("rebalance", "shard").write.option("maxRecordsPerFile", max_records).partitionBy("shard").parquet(path)
