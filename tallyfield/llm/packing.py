"""Packing by best-fit decreasing: documents become pieces, pieces share sequences with little padding.

Documents are encoded where they are read, end with an end token and are first cut into full windows; what is left of
each stays whole. Only the pieces' sizes and checksums (or their ids, if asked for) are shuffled. Pieces are dealt at
random into groups of about `GROUP_PIECES`; every group is packed alone, so the work is spread and no task sees more
than its share, at a cost of a few unfilled sequences per group. Within a group a segment tree over the remaining
capacities finds the tightest open window for the next smaller piece.

Defined cases: a missing or empty text is the end token alone; a missing doc_id stays missing; repeated rows are packed
one by one; a very long text gives full windows and one rest; an empty table gives no pieces; other columns never take
part.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.word_bpe import END, WordBpe, tokenizer_path
from tallyfield.session import materialised

WINDOW = 2048
END_TOKEN = 1
GROUP_PIECES = 8192
MARK = "\x01"


class LibraryWords(WordBpe):
    """The same cache of words and pieces, filled by the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = {t: self.library.token_to_id(t) for t in special}
        self.special_at = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.words, self.pieces = {}, {}
        (self.mark,) = self.library.encode(MARK, add_special_tokens=False).ids

    def encode_new(self, pieces: list[str]) -> list[bytes]:
        """Many pieces in one call, with a control character between them, which is a token of its own."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 1000):
            joined = f" {MARK} ".join(pieces[at : at + 1000])
            ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark).tolist()
            raw = ids.tobytes()
            out += [raw[4 * (i + 1) : 4 * j] for i, j in zip([-1, *cuts], [*cuts, len(ids)], strict=True)]
        return out

    def encode_odd(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class RankedTexts(LibraryWords):
    """Whole texts of plain characters, merged as byte strings by rank; all other texts go through the cache of words.

    A mark stands behind every piece, and joining the mark to the byte before it comes first, which gives the symbols that
    end a piece. A token that encodes to itself is made of the same parts wherever it stands, so its bytes stand for its
    merge; a token that does not encode to itself never comes up and has no rank.
    """

    PLAIN_TEXT = re.compile(r"[\t-\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
    PLAIN_PIECE = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~]+")  # of lower-case texts

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        bpe = WordBpe(path)
        byte_of = {c: b for b, c in enumerate(bpe.alphabet)}
        mark = MARK.encode()

        def symbols(token: str) -> bytes:
            body, end = (token[: -len(END)], mark) if token.endswith(END) else (token, b"")
            return bytes(map(byte_of.__getitem__, body)) + end

        stable = [(int(bpe.made[i]), symbols(t), i) for t, i in bpe.ids.items() if i in bpe.stable_ids and t]
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + mark: 256 + b for b in range(256)}
        for made, form, _ in sorted(stable):
            if made >= 0:
                ranks[form] = len(ranks)
        ids = np.zeros(len(ranks), "<u4")
        for _, form, i in stable:
            ids[ranks[form]] = i
        self.token_ids = ids
        self.ranked = tiktoken.Encoding(path, pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        plain, split = self.PLAIN_TEXT.fullmatch, self.PLAIN_PIECE.findall
        for text in texts:
            if plain(text) and (self.special_at is None or "<|" not in text):
                marked = MARK.join([*split(text.lower()), ""])
                yield self.token_ids[np.array(self.ranked.encode_ordinary(marked), np.int64)].tobytes()
            else:
                yield from super().encode_batch([text])


@lru_cache(maxsize=2)
def library_words(path: str) -> LibraryWords:
    return RankedTexts(path)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece: longest first, each into the open window with the least room that still fits."""
    size = 1 << capacity.bit_length()
    tree = [0] * (2 * size)  # number of open windows by remaining capacity; inner nodes hold sums
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    window, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def add(room: int, by: int) -> None:
        node = size + room
        while node:
            tree[node] += by
            node >>= 1

    def tightest(need: int) -> int:
        """The least remaining capacity of at least `need`, or -1."""
        node = size + need
        if tree[node]:
            return need
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < size:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - size

    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tightest(need)
        if room < 0:
            room, at = capacity, used
            used += 1
        else:
            at = open_[room].pop()
            add(room, -1)
        window[i], offset[i] = at, capacity - room
        if room > need:
            open_[room - need].append(at)
            add(room - need, 1)
    return window, offset


def cut_pieces(docs: DataFrame, path: str, doc_id: str, text: str, window: int, with_ids: bool) -> DataFrame:
    """Full windows and the rest of each document, with checksums."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    end = np.array([END_TOKEN], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library_words(path)
        for batch in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, raw in enumerate(words.encode_batch(batch.column(1).to_pylist())):
                raw += end
                n = len(raw) // 4
                for at in range(0, n, window):
                    piece = raw[4 * at : 4 * (at + window)]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<i4"))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
            columns += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return rows.mapInArrow(cut, schema)


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    group_pieces: int = GROUP_PIECES,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence; `with_ids` adds its token ids."""
    pieces = materialised(cut_pieces(docs, path or tokenizer_path(), doc_id, text, window, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # By the place in the written table, as rows may be equal in everything they hold.
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    fields = [(f.name, f.dataType.simpleString()) for f in pieces.schema.fields]
    schema = ", ".join(f"{n} {t}" for n, t in [*fields, ("sequence_id", "long"), ("offset", "long")])

    def pack(table: pa.Table) -> pa.Table:
        at, offset = best_fit(table.column("length").to_numpy(), window)
        sequence = (int(table.column("group")[0].as_py()) << 32) + at
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("group").applyInArrow(pack, schema)
