"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages; only the document has a label.  Every passage is encoded, gated
attention weighs the passages, and the weighted passage representation is scored.  Encoder, attention
and scorer are learned together from document labels, so a document can be judged by the passages
that give it away.

Training uses a sample of labelled documents of bounded size (SAMPLE_ROWS, the smallest hashes of the
id), each with all its passages.  Scoring reads every passage of every text.

Defined results.  Null and empty texts are one empty passage and get a score like any other.  Without
labels of both kinds every score is the share of label 1, or 0.5 without labels.  Rows with a null id are not held
out.  Equal texts get equal scores.  Other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ready_workers

#: Labelled documents that a model is fitted on, at most, and the most bytes of text among them.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 64 << 20
#: Words of a passage.
PASSAGE_WORDS = 64
#: Sizes of the passage representation and of the attention gate; training rounds.
HIDDEN, GATE, ROUNDS, BATCH = 16, 8, 40, 64

#: Kinds of byte: space, lower case, upper case, digit, mark, beyond ASCII.
_KINDS = 6
_kind = np.full(256, 4, np.uint8)
_kind[[9, 10, 11, 12, 13, 32]] = 0
_kind[97:123], _kind[65:91], _kind[48:58], _kind[128:] = 1, 2, 3, 5
N_FEATURES = _KINDS * _KINDS + 6


def passages(text: str | None) -> np.ndarray:
    """Features of every passage: (passages, N_FEATURES).

    Shares of neighbouring byte kinds; distinct words; mean word length; words as the one before;
    lines seen before in the document; words; long words.
    """
    raw = (text or "").encode()
    words = raw.split()
    n = max(1, -(-len(words) // PASSAGE_WORDS))
    out = np.zeros((n, N_FEATURES), np.float32)
    if not words:
        return out
    kinds = _kind[np.frombuffer(raw, np.uint8)]
    begins = (kinds != 0) & (np.concatenate([[0], kinds[:-1]]) == 0)
    # words as split() finds them start where a space precedes; the first word may start the text
    passage = np.maximum(np.cumsum(begins) - 1, 0) // PASSAGE_WORDS
    passage = np.minimum(passage, n - 1)
    width = _KINDS * _KINDS
    pairs = passage[1:] * width + kinds[:-1].astype(np.int64) * _KINDS + kinds[1:]
    counts = np.bincount(pairs, minlength=n * width).reshape(n, width)
    out[:, :width] = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    seen_lines: set[bytes] = set()
    repeated = total = 0
    for line in raw.split(b"\n"):
        total += 1
        repeated += line in seen_lines
        seen_lines.add(line)
    for k in range(n):
        some = words[k * PASSAGE_WORDS : (k + 1) * PASSAGE_WORDS]
        m = len(some)
        lengths = [len(w) for w in some]
        out[k, width:] = (
            len(set(some)) / m,
            sum(lengths) / m / 10,
            sum(a == b for a, b in zip(some, some[1:])) / m,
            repeated / total,
            m / PASSAGE_WORDS,
            sum(x > 20 for x in lengths) / m,
        )
    return out


class Model:
    """Encoder, gated attention and scorer, with their training by Adam."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
        self.p = {"E": draw(N_FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "b": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def forward(self, rows: np.ndarray, starts: np.ndarray):
        """All bags at once: rows holds their passages one bag after the other, starts the place of each bag's first."""
        p = self.p
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        sizes = np.diff(np.append(starts, len(rows)))
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))
        return x, h, t, g, a, z, y, sizes

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None or not bags:
            return np.full(len(bags), float(self.constant or 0.0))
        return self.forward(np.concatenate(bags), _starts(bags))[6]

    def gradients(self, rows: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict:
        """Of the sum of the bags' log losses."""
        p = self.p
        x, h, t, g, a, z, y, sizes = self.forward(rows, starts)
        d = y - labels
        dz = np.repeat(d[:, None] * p["c"], sizes, axis=0)
        da = (h * dz).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        outer = ds[:, None] * p["w"]
        dt, dg = outer * g * (1 - t * t), outer * t * g * (1 - g)
        dh = a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - h * h)
        return {"E": x.T @ dx, "e": dx.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": d @ z, "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], labels: list[int], seed: int = 11) -> "Model":
        if len(set(labels)) < 2:
            self.constant = sum(labels) / len(labels) if labels else 0.5
            return self
        stacked = np.concatenate(bags)
        self.mean, self.scale = stacked.mean(0).astype(np.float64), stacked.std(0).astype(np.float64) + 1e-3
        rng, first, second, step, of = np.random.default_rng(seed), {}, {}, 0, np.array(labels, np.float64)
        for number in range(ROUNDS):
            rate = 0.01 * (1 - number / ROUNDS) + 0.0005
            order = rng.permutation(len(bags))
            for start in range(0, len(order), BATCH):
                some = order[start : start + BATCH]
                chosen = [bags[i] for i in some]
                step += 1
                for k, v in self.gradients(np.concatenate(chosen), _starts(chosen), of[some]).items():
                    v = v / len(some) + 1e-4 * self.p[k]
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * v
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * v * v
                    self.p[k] = self.p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _starts(bags: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0, *(len(b) for b in bags[:-1])])


def held_out(doc_id: Column) -> Column:
    """The fifth of all ids whose labels no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int]]:
    """Texts and labels of at most SAMPLE_ROWS documents that are not held out, SAMPLE_BYTES in all."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    one = usable.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__label"))
    chosen = one.orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    texts = texts.groupBy("__id").agg(F.min(F.struct("__text", "__label")).alias("__row")).select("__id", "__row.*")
    got, size = [], 0
    for row in texts.orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE_ROWS).toLocalIterator():
        size += len(row["__text"].encode())
        if got and size > SAMPLE_BYTES:
            break
        got.append((row["__text"], row["__label"]))
    return got


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    sample = training_sample(docs, labels, id_col, text_col, label_col)
    return Model().fit([passages(t) for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 if score >= threshold)."""
    ready_workers(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"

    def run(batches):
        model = sent.value
        for batch in batches:
            scores = model.scores([passages(t) for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= threshold).astype(np.int32), pa.int32())})

    return rows.mapInArrow(run, schema)
