"""BPE encoding and decoding: speculate and verify.

A word is first covered by greedy longest match. The guess is the true encoding exactly if every token encodes to itself
and no merge would ever cross the border of two neighbours; both are decided from the merge ranks alone, for all
distinct neighbours of a batch at once, and remembered. Only words with a forbidden border are merged step by step.

Words between white space are encoded once per worker and remembered up to a bound, so memory does not grow with the
text. Characters outside a plain set, whose normal form or case differs between libraries, go through the tokenizer
file's own normaliser and word splitter; their pieces are encoded like all others.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
MAX_WORDS = 500_000
SHORT_WORD = 48  # symbols; up to here scanning all pairs per merge is faster than a heap
END = "</w>"

# Characters whose lower case and composed form are the same in every library: ASCII and the letters of Latin-1.
PLAIN = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
PIECE = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
ODD_SPACE = re.compile("[\x1c-\x1f]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.ids: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_at = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.texts = [""] * (max([*self.ids.values(), *special.values()]) + 1)
        for text, i in [*self.ids.items(), *special.items()]:
            self.texts[i] = text
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = len(self.texts)
        self.rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made = np.full(n, -1, np.int64)  # rank of the merge that makes a token, -1 for single characters
        self.merged = {}
        for r, (a, b) in enumerate(pairs):
            whole = self.ids[a + b]
            self.parts[whole], self.made[whole], self.merged[(self.ids[a], self.ids[b])] = (self.ids[a], self.ids[b]), r, whole
        self.stable_ids = {t for t in self.ids.values() if self.merge(self.leaves(t)) == [t]}
        self.reach: dict[str, int] = {}  # by the first three characters, the length of the longest token inside a word
        for text in self.ids:
            if not text.endswith(END):
                self.reach[text[:3]] = max(self.reach.get(text[:3], 0), len(text))
        self.keys = np.array([a * n + b for a, b in self.rank], np.int64)
        self.longest_end = max((len(text) for text in self.ids if text.endswith(END)), default=0)
        order = np.argsort(self.keys)
        self.keys, self.key_ranks, self.n = self.keys[order], np.array(list(self.rank.values()), np.int64)[order], n
        self.alphabet = byte_alphabet()
        self.pair_ok: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self._library = None

    # --- exact merging -------------------------------------------------------------------------------------------

    def symbols(self, piece: str) -> list[int]:
        """Single-character tokens of a piece in the byte alphabet."""
        return [self.ids[c] for c in piece[:-1]] + [self.ids[piece[-1] + END]]

    def merge(self, tokens: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until no pair can be merged."""
        if len(tokens) > SHORT_WORD:
            return self.merge_long(tokens)
        tokens, rank = list(tokens), self.rank
        ranks = [rank.get(p, 1 << 60) for p in zip(tokens, tokens[1:], strict=False)]
        while ranks and (best := min(ranks)) < 1 << 60:
            i = ranks.index(best)
            tokens[i : i + 2] = [self.merged[(tokens[i], tokens[i + 1])]]
            del ranks[i]
            if i > 0:
                ranks[i - 1] = rank.get((tokens[i - 1], tokens[i]), 1 << 60)
            if i < len(ranks):
                ranks[i] = rank.get((tokens[i], tokens[i + 1]), 1 << 60)
        return tokens

    def merge_long(self, tokens: list[int]) -> list[int]:
        """The same merges from a heap over linked neighbours, n log n in the length of the word."""
        tokens, rank, n = list(tokens), self.rank, len(tokens)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[p], i, p) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (tokens[i], tokens[j]) != pair:  # one of the two has been merged since
                continue
            tokens[i], tokens[j] = self.merged[pair], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := rank.get((tokens[left], tokens[right]))) is not None:
                    heapq.heappush(heap, (r, left, (tokens[left], tokens[right])))
        return [t for t in tokens if t >= 0]

    # --- verification --------------------------------------------------------------------------------------------

    def leaves(self, token: int) -> list[int]:
        stack, out = [token], []
        while stack:
            t = stack.pop()
            if t in self.parts:
                a, b = self.parts[t]
                stack += [b, a]
            else:
                out.append(t)
        return out

    def spine(self, token: int, side: int) -> list[int]:
        """The token, its part at one end, that part's part, and so on."""
        out = [token]
        while out[-1] in self.parts:
            out.append(self.parts[out[-1]][side])
        return out

    def borders_ok(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether no merge crosses their border.

        At any moment the border lies between a part on the left token's right edge and one on the right token's left
        edge. A merge of the two crosses it if its turn comes after both exist and before either is used up; at equal
        turns the place further left goes first.
        """
        tokens = np.unique(np.concatenate([left, right]))
        place = {int(t): i for i, t in enumerate(tokens)}
        at = np.vectorize(place.__getitem__, otypes=[np.int64])
        edges = []
        for side in (1, 0):
            spines = [self.spine(int(t), side) for t in tokens]
            wide = max(map(len, spines))
            part = np.full((len(tokens), wide), -1, np.int64)
            for i, s in enumerate(spines):
                part[i, : len(s)] = s
            born = np.where(part >= 0, self.made[part], -1)
            used = np.full_like(born, 1 << 60)
            used[:, 1:] = born[:, :-1]
            edges.append((part, born, used))
        (lp, lb, lu), (rp, rb, ru) = edges
        li, ri = at(left), at(right)
        ok = np.ones(len(left), bool)
        for j in range(lp.shape[1]):
            for k in range(rp.shape[1]):
                a, b = lp[li, j], rp[ri, k]
                key = a * self.n + b
                pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                turn = np.where((self.keys[pos] == key) & (a >= 0) & (b >= 0), self.key_ranks[pos], -1)
                ok &= ~((turn > lb[li, j]) & (turn > rb[ri, k]) & (turn < lu[li, j]) & (turn <= ru[ri, k]) & (turn >= 0))
        return ok

    # --- encoding ------------------------------------------------------------------------------------------------

    def guess(self, piece: str) -> list[int]:
        """Greedy longest match from the left over tokens that encode to themselves."""
        get, stable, reach, out, i, n = self.ids.get, self.stable_ids, self.reach, [], 0, len(piece)
        whole = piece + END
        while True:
            t = get(whole[i:]) if len(whole) - i <= self.longest_end else None
            if t is not None and t in stable:
                out.append(t)
                return out
            j = min(n - 1, i + reach.get(piece[i : i + 3], 2))
            while (t := get(piece[i:j])) is None or t not in stable:
                j -= 1
            out.append(t)
            i = j

    def encode_new(self, pieces: list[str]) -> list[bytes]:
        """Ids of lower-case pieces that are not known yet."""
        return self.verified([self.byte_text(p) for p in pieces])

    def encode_odd(self, text: str) -> bytes:
        """Ids of a text with unusual characters, split by the tokenizer file's own rules."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        normal = self._library.normalizer.normalize_str(text)
        return b"".join(self.verified([p for p, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]))

    def verified(self, new: list[str]) -> list[bytes]:
        """Ids of pieces in the byte alphabet: guesses where all borders hold, merged step by step elsewhere."""
        guesses = [self.guess(p) for p in new]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(new)), sizes)
        inner = np.flatnonzero(word[1:] == word[:-1])
        keys, back = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
        known = self.pair_ok
        if len(known) > 4 * MAX_WORDS:
            known.clear()
        if open_ := [k for k in keys.tolist() if k not in known]:
            arr = np.array(open_, np.int64)
            known.update(zip(open_, self.borders_ok(arr // self.n, arr % self.n).tolist(), strict=True))
        good = np.fromiter((known[k] for k in keys.tolist()), bool, len(keys))
        failed = np.zeros(len(new), bool)
        failed[word[inner][~good[back]]] = True
        for i in np.flatnonzero(failed).tolist():
            guesses[i] = self.merge(self.symbols(new[i]))
        return [np.array(g, "<u4").tobytes() for g in guesses]

    def byte_text(self, text: str) -> str:
        return text if text.isascii() else "".join([self.alphabet[b] for b in text.encode()])

    def learn(self, words: list[str]) -> None:
        """Encode words between white space that are not known yet."""
        plain = []
        for w in words:
            if self.special_at is not None and "<|" in w and self.special_at.search(w):
                parts = [np.array([self.special[x]], "<u4").tobytes() if x in self.special else self.encode_odd(x) for x in self.special_at.split(w) if x]
                self.words[w] = b"".join(parts)
            elif PLAIN.fullmatch(w):
                plain.append(w)
            else:
                self.words[w] = self.encode_odd(w)
        if not plain:
            return
        split: list[list[str]] = [[]]
        for p in PIECE.findall("\n".join(plain).lower()):
            if p == "\n":
                split.append([])
            else:
                split[-1].append(p)
        known = self.pieces
        if len(known) > MAX_WORDS:
            known.clear()
        new = list({p for pieces in split for p in pieces if p not in known})
        known.update(zip(new, self.encode_new(new), strict=True))
        get = known.__getitem__
        self.words.update((w, b"".join(map(get, pieces))) for w, pieces in zip(plain, split, strict=True))

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers, in order."""
        group: list[list[str]] = []
        held = 0
        for text in texts:
            words = self.split_spaces(text)
            group.append(words)
            held += len(words)
            if held > 200_000:
                yield from self._encode_group(group)
                group, held = [], 0
        yield from self._encode_group(group)

    def split_spaces(self, text: str) -> list[str]:
        """Words between white space; a text with separators that only some libraries call white space stays whole."""
        if ODD_SPACE.search(text):
            return [text]
        return text.split()

    def _encode_group(self, group: list[list[str]]) -> list[bytes]:
        known = self.words
        if new := {w for words in group for w in words if w not in known}:
            if len(known) > MAX_WORDS:
                known.clear()
                new = {w for words in group for w in words}
            self.learn(list(new))
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in group]

    def decode(self, ids: np.ndarray) -> str:
        """What the file's decoder gives: it has none, so tokens are joined by spaces."""
        return " ".join(map(self.texts.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    """One encoder per worker and tokenizer file."""
    return WordBpe(path)


def encoded(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: number of tokens, the ids, and checksums of the ids and of the decoded text.

    Map only: each row is encoded where it is read. Defined cases: a missing text counts as empty (no ids, checksums of
    nothing); a missing doc_id stays missing; repeated rows are encoded one by one; other columns never take part.
    `with_ids=False` leaves the ids out.
    """
    path = path or tokenizer_path()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    schema_names = [c.split()[0] for c in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        names = np.array([str(i) for i in range(len(bpe.texts))], object)
        texts = np.array(bpe.texts, object)
        for batch in batches:
            counts, first, second, ids = [], [], [], []
            for raw in bpe.encode_batch(batch.column(1).to_pylist()):
                tokens = np.frombuffer(raw, "<u4")
                counts.append(len(tokens))
                first.append(hashlib.sha256(" ".join(names[tokens].tolist()).encode()).hexdigest())
                second.append(hashlib.sha256(" ".join(texts[tokens].tolist()).encode()).hexdigest())
                if with_ids:
                    ids.append(tokens.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            columns += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=schema_names)

    return rows.mapInArrow(encode, schema)


def decoded(ids: DataFrame, path: str | None = None, doc_id: str = "doc_id", column: str = "ids") -> DataFrame:
    """One row per document: the text that the tokenizer file's decoder gives for its ids (a missing list gives none)."""
    path = path or tokenizer_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.asarray(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return ids.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column).alias("ids")).mapInArrow(decode, "doc_id long, decoded string")
