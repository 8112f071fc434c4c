"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of one run of letters at a time, forwards and backwards, and gives every byte
probabilities of the languages; a document's probabilities are the mean over all its bytes. A run is the unit of
recurrence: equal runs get equal labels, so each worker labels a run once, remembers its summed probabilities up to a
bound, and adds them up per document. Every byte of every run of a text counts, however long the text.

Training is plain backpropagation through time in numpy, on the driver, over a bounded sample: at most `PER_LANGUAGE`
distinct documents of each language, chosen by a hash of id and text, and at most `RUNS_PER_DOC` distinct runs of each,
spread over the whole text by a hash. Only text and language of documents outside the held-out fold take part.

Defined cases: a missing text or one without letters gets `und` and score 0; documents without a language or an id are
predicted but never learned from; repeated rows are predicted one by one and learned from once; a corpus without any labelled document gives
`und` everywhere; other columns never take part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.session import materialised

PER_LANGUAGE = 400
RUNS_PER_DOC = 48
SAMPLE_BITS = 6  # leading bits of a hash that make its range
MAX_LANGUAGES = 200
HIDDEN = 24
EPOCHS = 4
BATCH = 256
STEP = 0.01
MAX_RUNS = 400_000
LONGEST = 24  # letters; longer runs are cut into pieces of this length
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
RUN = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)


class ByteGru:
    """Two gated recurrent layers, one per direction, and a softmax over languages at every byte."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.h, k = languages, hidden, len(languages)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"out": draw(2 * hidden, k), "bias": np.zeros(k, np.float32)}
        for d in "fb":
            self.p[f"{d}_in"] = 0.3 * rng.standard_normal((256, 3 * hidden)).astype(np.float32)  # update, reset, candidate
            self.p[f"{d}_gates"] = draw(hidden, 2 * hidden)
            self.p[f"{d}_cand"] = draw(hidden, hidden)

    def _forward(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States after each byte; a padded place leaves the state as it is."""
        h, n = self.h, len(x)
        state, states, tape = np.zeros((n, h), np.float32), np.zeros((x.shape[1], n, h), np.float32), []
        for t in range(x.shape[1]):
            given = self.p[f"{d}_in"][x[:, t]]
            gates = _sigmoid(given[:, : 2 * h] + state @ self.p[f"{d}_gates"])
            z, r = gates[:, :h], gates[:, h:]
            kept = r * state
            c = np.tanh(given[:, 2 * h :] + kept @ self.p[f"{d}_cand"])
            m = mask[:, t, None]
            new = state + m * z * (c - state)
            tape.append((state, z, r, kept, c, m))
            state = states[t] = new
        return states, tape

    def _backward(self, x: np.ndarray, tape: list, up: np.ndarray, d: str, grad: dict) -> None:
        """Add the gradients of one direction; `up` holds the loss's gradient at each state."""
        h = self.h
        carry = np.zeros_like(tape[0][0])
        for t in range(x.shape[1] - 1, -1, -1):
            state, z, r, kept, c, m = tape[t]
            g = carry + up[t]
            gc = g * m * z * (1 - c * c)
            gz = g * m * (c - state) * z * (1 - z)
            gk = gc @ self.p[f"{d}_cand"].T
            gr = gk * state * r * (1 - r)
            gates = np.concatenate([gz, gr], axis=1)
            grad[f"{d}_cand"] += kept.T @ gc
            grad[f"{d}_gates"] += state.T @ gates
            np.add.at(grad[f"{d}_in"], x[:, t], np.concatenate([gates, gc], axis=1))
            carry = g * (1 - m * z) + gk * r + gates @ self.p[f"{d}_gates"].T

    def states(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list, list]:
        forward, ft = self._forward(x, mask, "f")
        backward, bt = self._forward(x[:, ::-1], mask[:, ::-1], "b")
        return np.concatenate([forward, backward[::-1]], axis=2), ft, bt

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Byte, run, language."""
        return _softmax(self.states(x, mask)[0] @ self.p["out"] + self.p["bias"])

    def train(self, runs: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        share = np.bincount(labels, minlength=len(self.languages)).clip(1)
        weight = (len(labels) / len(self.languages) / share).astype(np.float32)
        length = np.fromiter(map(len, runs), np.int64, len(runs))
        steps = 0
        for epoch in range(epochs):
            order = rng.permutation(len(runs))
            order = order[np.argsort(length[order] // 2, kind="stable")]  # batches of similar lengths
            batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            for b in rng.permutation(len(batches)):
                rows = batches[b]
                x, mask = padded([runs[i] for i in rows])
                hidden, ft, bt = self.states(x, mask)
                prob = _softmax(hidden @ self.p["out"] + self.p["bias"])
                wanted = np.zeros_like(prob)
                wanted[:, np.arange(len(rows)), labels[rows]] = 1
                g = (prob - wanted) * (mask.T[:, :, None] * weight[labels[rows]][None, :, None] / mask.sum())
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                grad["out"] = np.einsum("tnh,tnk->hk", hidden, g)
                grad["bias"] = g.sum(axis=(0, 1))
                up = g @ self.p["out"].T
                self._backward(x, ft, up[:, :, : self.h], "f", grad)
                self._backward(x[:, ::-1], bt, up[::-1, :, self.h :], "b", grad)
                steps += 1
                rate = STEP * (1 - 0.9 * (epoch * len(batches) + 0.5 * len(batches)) / (epochs * len(batches)))
                for k, v in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] -= rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)

    def run_sums(self, runs: list[bytes]) -> np.ndarray:
        """Per run the probabilities of each language summed over its bytes, and the number of bytes."""
        out = np.zeros((len(runs), len(self.languages) + 1), np.float32)
        length = np.fromiter(map(len, runs), np.int64, len(runs))
        order = np.argsort(length, kind="stable")
        for at in range(0, len(order), 4096):
            rows = order[at : at + 4096]
            x, mask = padded([runs[i] for i in rows])
            out[rows, :-1] = (self.probabilities(x, mask) * mask.T[:, :, None]).sum(axis=0)
            out[rows, -1] = length[rows]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the runs as a matrix and 1.0 where a byte stands."""
    length = np.fromiter(map(len, runs), np.int64, len(runs))
    mask = np.arange(length.max(initial=1))[None, :] < length[:, None]
    x = np.zeros(mask.shape, np.uint8)
    x[mask] = np.frombuffer(b"".join(runs), np.uint8)
    return x, mask.astype(np.float32)


def runs_of(text: str) -> list[str]:
    return RUN.findall(text.lower())


class RunScores:
    """Summed probabilities per run, remembered up to a bound."""

    def __init__(self, model: ByteGru):
        self.model, self.at = model, {}
        self.sums = np.zeros((0, len(model.languages) + 1), np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Summed probabilities and number of bytes per text."""
        found = [runs_of(t) if t else [] for t in texts]
        known = self.at
        if len(known) > MAX_RUNS:
            known.clear()
            self.sums = self.sums[:0]
        if new := list({r for runs in found for r in runs if r not in known}):
            known.update(zip(new, range(len(self.sums), len(self.sums) + len(new)), strict=True))
            self.sums = np.concatenate([self.sums, self.model.run_sums([r.encode() for r in new])])
        total = np.zeros((len(texts), self.sums.shape[1]))
        for i, runs in enumerate(found):
            if runs:
                rows = np.fromiter(map(known.__getitem__, runs), np.int64, len(runs))
                total[i] = self.sums[rows].sum(axis=0, dtype=np.float64)
        return total


def held_out(doc_id: Column) -> Column:
    """Whether the document is in the fold that is never learned from; so is one without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def training_runs(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int) -> DataFrame:
    """Runs with their language from the bounded sample: `lang`, `doc_id`, `print` (the text's hash) and `run`.

    A document of the sample is a distinct (language, id, text), so repeated rows count once and an id with many texts
    takes no more places than its texts.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("body").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.withColumn("print", F.xxhash64("body"))
    ids = ["lang", "doc_id", "print"]
    key = F.xxhash64("doc_id", "print")
    # The smallest hashes of each language: the first rows of each range of hashes, then of the first ranges that suffice.
    parts = rows.select(*ids).distinct().withColumn("part", F.shiftright(key, 64 - SAMPLE_BITS))
    first = Window.orderBy(key, "doc_id", "print")
    in_part = parts.withColumn("n", F.row_number().over(first.partitionBy("lang", "part"))).where(F.col("n") <= per_language).drop("n")
    in_part = materialised(in_part, "language-parts")
    below = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = in_part.groupBy("lang", "part").count().withColumn("below", F.coalesce(F.sum("count").over(below), F.lit(0)))
    enough = in_part.join(sizes.where(F.col("below") < per_language).select("lang", "part"), ["lang", "part"], "left_semi")
    chosen = enough.withColumn("n", F.row_number().over(first.partitionBy("lang"))).where(F.col("n") <= per_language)
    sample = rows.join(materialised(chosen.select(*ids), "language-sample"), ids, "left_semi").select(*ids, "body")
    schema = f"lang string, doc_id {dict(rows.dtypes)['doc_id']}, print long, run string"

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, at = [], []
            for i, body in enumerate(batch.column(3).to_pylist()):
                some = sorted(set(runs_of(body)), key=lambda r: (zlib.crc32(r.encode()), r))[:RUNS_PER_DOC]
                runs += some
                at += [i] * len(some)
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(runs, pa.string())], names=[*ids, "run"])

    return sample.mapInArrow(pick, schema).distinct()


def fit(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int = PER_LANGUAGE) -> ByteGru | None:
    """The trained network, or None if nothing is labelled. At most MAX_LANGUAGES languages, or an error."""
    table = training_runs(docs, doc_id, text, lang, per_language).select("run", "lang").toArrow()
    pairs = sorted(zip(table.column("run").to_pylist(), table.column("lang").to_pylist(), strict=True))
    languages = sorted({p[1] for p in pairs})
    if not languages:
        return None
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the sample is bounded for {MAX_LANGUAGES}")
    model = ByteGru(languages)
    place = {name: i for i, name in enumerate(languages)}
    model.train([r.encode() for r, _ in pairs], np.array([place[name] for _, name in pairs]))
    return model


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: ByteGru | None = None) -> DataFrame:
    """One row per document: fold, predicted language and its mean probability over the text's bytes."""
    model = model or fit(docs, doc_id, text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("body"))
    kind = dict(rows.dtypes)["doc_id"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = None if model is None else RunScores(model)
        for batch in batches:
            langs, best = predicted(scores, batch.column(2))
            columns = [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def predicted(scores: RunScores | None, bodies: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text, a few hundred texts at a time."""
    langs, best = [], []
    for at in range(0, len(bodies), 256):
        texts = bodies.slice(at, 256).to_pylist()
        total = np.zeros((len(texts), 2)) if scores is None else scores.score(texts)
        for i, k in enumerate(total[:, :-1].argmax(axis=1).tolist()):
            some = total[i, -1] > 0
            langs.append(scores.model.languages[k] if some else UNKNOWN)
            best.append(min(1.0, total[i, k] / total[i, -1]) if some else 0.0)
    return langs, best


def accepted(docs: DataFrame, min_score: float = 0.4, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows, all columns as they are, whose language is known with at least `min_score`.

    Where nothing is labelled there is nothing to judge by, and every row with a letter in its text stays.
    """
    model = fit(docs, doc_id, text, lang)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = None if model is None else RunScores(model)
        for batch in batches:
            if scores is None:
                yield batch.filter(pa.array([bool(t and runs_of(t)) for t in batch.column(at).to_pylist()], pa.bool_()))
                continue
            langs, best = predicted(scores, batch.column(at))
            yield batch.filter(pa.array([g != UNKNOWN and s >= min_score for g, s in zip(langs, best, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
