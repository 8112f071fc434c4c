"""String distances over columns.

Built-ins wherever Spark has them. The edit distances it lacks run as Arrow functions: a whole batch of pairs advances
through the table of edit costs together, so the Python work per pair is a share of a few array operations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS, WORDS = 4_000_000, 4_096


def _codes(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    table = np.full((len(texts), int(lengths.max(initial=0))), fill, dtype=np.int64)
    for i, t in enumerate(texts):
        table[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
    return table, lengths


def _batches(left: pd.Series, right: pd.Series, area: bool = False):
    """Pairs without missing sides, grouped by length so that a batch wastes little padding.

    A batch holds at most CELLS numbers: one row of each pair's table, or the whole table with `area`.
    """
    known = np.flatnonzero((left.notna() & right.notna()).to_numpy())
    a, b = left.to_numpy(dtype=object), right.to_numpy(dtype=object)
    order = sorted(known, key=lambda i: (len(a[i]), len(b[i])))
    start = 0
    while start < len(order):
        stop, width = start, 0
        while stop < len(order):
            width = max(width, (len(b[order[stop]]) + 1) * (len(a[order[stop]]) + 1 if area else 1))
            if stop > start and (stop - start + 1) * width > CELLS:
                break
            stop += 1
        rows = order[start:stop]
        yield np.array(rows), [a[i] for i in rows], [b[i] for i in rows]
        start = stop


def _table_distance(a: list[str], b: list[str], substitute: bool, transpose: bool) -> np.ndarray:
    """Unit-cost edit distance of many pairs; optional substitutions and adjacent swaps."""
    x, nx = _codes(a, -1)
    y, ny = _codes(b, -2)
    pairs, width = y.shape
    steps = np.arange(width + 1)
    row, above, above2 = np.tile(steps, (pairs, 1)), None, None
    result = row[np.arange(pairs), ny].copy()
    for i in range(1, x.shape[1] + 1):
        above2, above = above, row
        same = x[:, i - 1 : i] == y
        cost = np.where(same, 0, 1 if substitute else 2)
        best = np.minimum(above[:, 1:] + 1, above[:, :-1] + cost)
        if transpose and above2 is not None and width > 1:
            swapped = (x[:, i - 1 : i] == y[:, :-1]) & (x[:, i - 2 : i - 1] == y[:, 1:])
            best[:, 1:] = np.where(swapped, np.minimum(best[:, 1:], above2[:, :-2] + 1), best[:, 1:])
        first = np.full((pairs, 1), i)
        # An insertion costs one per step, so the row is the running minimum of (cell - position) plus the position.
        row = np.minimum.accumulate(np.hstack([first, best]) - steps, axis=1) + steps
        done = nx == i
        result[done] = row[done, ny[done]]
    return result


def _osa_words(a: list[str], b: list[str]) -> np.ndarray:
    """`_table_distance` with substitutions and swaps for texts of at most 64 characters in `a`.

    A column of the table is held as its steps up and down, a bit per character of `a` in one 64-bit number per pair.
    """
    x, nx = _codes(a, -1)
    y, ny = _codes(b, -2)
    x = np.pad(x, ((0, 0), (0, 64 - x.shape[1])), constant_values=-1).astype(np.int32)
    y = np.ascontiguousarray(y.T.astype(np.int32))
    result, distance, one = nx.copy(), nx.copy(), np.uint64(1)
    last = one << np.maximum(nx - 1, 0).astype(np.uint64)
    up, down = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
    same_before, flat = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    for j in range(len(y)):
        same = np.packbits(x == y[j][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        swapped = ((~flat & same) << one) & same_before
        flat = (((same & up) + up) ^ up) | same | down | swapped
        right, left = down | ~(flat | up), flat & up
        distance = distance + ((right & last) != 0) - ((left & last) != 0)
        right, left = (right << one) | one, left << one
        up, down = left | ~(flat | right), right & flat
        same_before = same
        done = ny == j + 1
        result[done] = distance[done]
    return np.where(nx == 0, ny, result)


def _batched(left: pd.Series, right: pd.Series, substitute: bool, transpose: bool) -> pd.Series:
    out = pd.Series(np.nan, index=range(len(left)), dtype="float64")
    for rows, a, b in _batches(left, right):
        out.iloc[rows] = _table_distance(a, b, substitute, transpose)
    return out.astype("Int64")


def _osa(left: pd.Series, right: pd.Series) -> pd.Series:
    """Optimal string alignment: edits plus swaps of neighbours, no part edited twice."""
    out = pd.Series(np.nan, index=range(len(left)), dtype="float64")
    for rows, a, b in _batches(left, right):
        for i in range(0, len(rows), WORDS):
            some = slice(i, i + WORDS)
            if len(a[some][-1]) <= 64:  # the longest
                out.iloc[rows[some]] = _osa_words(a[some], b[some])
            else:
                out.iloc[rows[some]] = _table_distance(a[some], b[some], substitute=True, transpose=True)
    return out.astype("Int64")


osa = F.pandas_udf(_osa, T.IntegerType())
# Spark neither repeats a function marked like this nor moves it below a distinct or a union.
osa_in_place = F.pandas_udf(_osa, T.IntegerType()).asNondeterministic()


@F.pandas_udf(T.IntegerType())
def lcs(left: pd.Series, right: pd.Series) -> pd.Series:
    """Insertions and deletions only."""
    return _batched(left, right, substitute=False, transpose=False)


def _damerau_table(a: list[str], b: list[str]) -> np.ndarray:
    """Edits plus swaps whose parts may be edited again, for many pairs: the whole table of costs is kept."""
    x, nx = _codes(a, -1)
    y, ny = _codes(b, -2)
    pairs, width = y.shape
    steps, columns, at = np.arange(width + 1), np.arange(1, width + 1), np.arange(pairs)[:, None]
    table = np.zeros((x.shape[1] + 1, pairs, width + 1), dtype=np.int32)
    table[0] = steps
    last_row = np.zeros((pairs, width), dtype=np.int64)  # last row whose character equals the column's
    for i in range(1, x.shape[1] + 1):
        same = x[:, i - 1 : i] == y
        reached = np.maximum.accumulate(np.where(same, columns, 0), axis=1)
        last_col = np.hstack([np.zeros((pairs, 1), dtype=np.int64), reached[:, :-1]])[:, :width]
        known = (last_row > 0) & (last_col > 0)
        swap = table[np.maximum(last_row - 1, 0), at, np.maximum(last_col - 1, 0)] + (i - last_row) + (columns - last_col - 1)
        above = table[i - 1]
        best = np.minimum(above[:, 1:] + 1, above[:, :-1] + ~same)
        best = np.where(known, np.minimum(best, swap), best)
        row = np.hstack([np.full((pairs, 1), i), best]) - steps
        table[i] = np.minimum.accumulate(row, axis=1) + steps
        last_row[same] = i
    return table[nx, np.arange(pairs), ny]


def _jaro_table(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro distance of many pairs: each character takes the first free equal one within reach."""
    x, nx = _codes(a, -1)
    y, ny = _codes(b, -2)
    pairs, width = y.shape
    reach = np.maximum(np.maximum(nx, ny) // 2 - 1, 0)[:, None]
    columns, rows = np.arange(width)[None, :], np.arange(pairs)
    taken, kept = np.zeros(y.shape, dtype=bool), np.zeros(x.shape, dtype=bool)
    for i in range(x.shape[1] if width else 0):
        free = (x[:, i : i + 1] == y) & ~taken & (np.abs(columns - i) <= reach)
        hit = free.any(axis=1)
        taken[rows[hit], free.argmax(axis=1)[hit]] = True
        kept[:, i] = hit
    m = kept.sum(axis=1)
    front = lambda codes, mask: np.take_along_axis(codes, np.argsort(~mask, axis=1, kind="stable"), axis=1)
    most = int(m.max(initial=0))
    differ = (front(x, kept)[:, :most] != front(y, taken)[:, :most]) & (np.arange(most)[None, :] < m[:, None])
    half_swaps = differ.sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        near = (m / nx + m / ny + (m - half_swaps) / m) / 3.0
    return np.where((nx == 0) & (ny == 0), 0.0, np.where(m == 0, 1.0, 1.0 - near))


@F.pandas_udf(T.IntegerType())
def damerau(left: pd.Series, right: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=range(len(left)), dtype="float64")
    for rows, a, b in _batches(left, right, area=True):
        out.iloc[rows] = _damerau_table(a, b)
    return out.astype("Int64")


@F.pandas_udf(T.DoubleType())
def jaro(left: pd.Series, right: pd.Series) -> pd.Series:
    """Jaro distance (Jaro-Winkler without a prefix bonus)."""
    out = pd.Series(np.nan, index=range(len(left)), dtype="float64")
    for rows, a, b in _batches(left, right):
        out.iloc[rows] = _jaro_table(a, b)
    return out.astype("Float64").mask(left.isna().to_numpy() | right.isna().to_numpy())


def _characters(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _with_characters(a: Column, b: Column, body) -> Column:
    """`body(characters of a, characters of b)`, each text cut once per row."""
    cut = F.struct(_characters(a).alias("x"), _characters(b).alias("y"))
    return F.get(F.transform(F.array(cut), lambda s: body(s["x"], s["y"])), F.lit(0))


def _counts(x: Column, y: Column) -> Column:
    """(count in x, count in y) of every character of either."""
    times = lambda chars, ch: F.size(F.filter(chars, lambda c: c == ch)).cast("double")
    return F.transform(F.array_union(x, y), lambda ch: F.struct(times(x, ch).alias("m"), times(y, ch).alias("n")))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions; infinite when the lengths differ."""
    differing = F.zip_with(_characters(a), _characters(b), lambda x, y: F.when(x == y, 0.0).otherwise(1.0))
    return F.when(F.length(a) != F.length(b), F.lit(float("inf"))).otherwise(
        F.aggregate(differing, F.lit(0.0), lambda acc, d: acc + d)
    )


def qgram(a: Column, b: Column) -> Column:
    """Sum of absolute differences of character counts."""
    total = lambda x, y: F.aggregate(_counts(x, y), F.lit(0.0), lambda acc, c: acc + F.abs(c["m"] - c["n"]))
    return F.when(a.isNotNull() & b.isNotNull(), _with_characters(a, b, total).cast("int"))


def cosine(a: Column, b: Column) -> Column:
    """One minus the cosine of the two count vectors; three sums in one pass over the characters."""
    zero = F.struct(F.lit(0.0).alias("mn"), F.lit(0.0).alias("mm"), F.lit(0.0).alias("nn"))

    def add(acc: Column, c: Column) -> Column:
        m, n = c["m"], c["n"]
        return F.struct((acc["mn"] + m * n).alias("mn"), (acc["mm"] + m * m).alias("mm"), (acc["nn"] + n * n).alias("nn"))

    def end(acc: Column) -> Column:
        return 1.0 - F.try_divide(acc["mn"], F.sqrt(acc["mm"]) * F.sqrt(acc["nn"]))

    apart = _with_characters(a, b, lambda x, y: F.aggregate(_counts(x, y), zero, add, end))
    return F.when(a == b, F.lit(0.0)).when(a.isNotNull() & b.isNotNull(), apart)


def jaccard(a: Column, b: Column) -> Column:
    x, y = _characters(a), _characters(b)
    return F.when(a == b, F.lit(0.0)).otherwise(
        1.0 - F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)))
    )


def soundex_differs(a: Column, b: Column) -> Column:
    return F.when(F.soundex(a) != F.soundex(b), 1).when(a.isNotNull() & b.isNotNull(), 0)


def distance_columns(a: Column, b: Column) -> list[Column]:
    """The ten metrics of one pair."""
    return [
        osa(a, b).alias("osa"),
        F.levenshtein(a, b).alias("lv"),
        damerau(a, b).alias("dl"),
        hamming(a, b).alias("hamming"),
        lcs(a, b).alias("lcs"),
        qgram(a, b).alias("qgram"),
        cosine(a, b).alias("cosine"),
        jaccard(a, b).alias("jaccard"),
        jaro(a, b).alias("jw"),
        soundex_differs(a, b).alias("soundex"),
    ]
