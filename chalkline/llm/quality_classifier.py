"""Attention-based multiple-instance quality classifier.

A document is a bag of passages of PASSAGE_WORDS words. Every passage is encoded
(character shares, word length, repetition), a gated attention layer weighs the
passages, and the weighted sum is scored. Weights are learned from document
labels only; no passage has a label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .shared import bounded_labels, text_bytes

PASSAGE_WORDS = 64
#: Most labelled documents that a fit reads; all their passages count.
FIT_DOCUMENTS = 2000
THRESHOLD = 0.3
HIDDEN, GATE = 16, 8
N_FEATURES = 133


def passage_features(text: bytes) -> np.ndarray:
    """One row for each passage of the whole text; an empty text is one passage of zeros."""
    words = text.split()
    if not words:
        return np.zeros((1, N_FEATURES), np.float32)
    n = -(-len(words) // PASSAGE_WORDS)
    out = np.zeros((n, N_FEATURES), np.float32)
    seen: set[bytes] = set()
    for i in range(n):
        part = words[i * PASSAGE_WORDS : (i + 1) * PASSAGE_WORDS]
        joined = b" ".join(part)
        counts = np.bincount(np.frombuffer(joined, np.uint8), minlength=256)
        own = set(part)
        out[i, :128] = counts[:128]
        out[i, 128] = counts[128:].sum()
        out[i, :129] /= len(joined)
        out[i, 129] = len(joined) / len(part) / 10
        out[i, 130] = len(own) / len(part)
        out[i, 131] = len(own - seen) / len(own)
        out[i, 132] = len(part) / PASSAGE_WORDS
        seen |= own
    np.sqrt(out[:, :129], out=out[:, :129])
    return out


class AttentionModel:
    """Gated attention over passages: weights softmax(w . tanh(Vh) * sigmoid(Uh))."""

    def __init__(self, mean, scale, params):
        self.mean, self.scale, self.params = mean, scale, params

    @staticmethod
    def initial(rng):
        f = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        return {"E": f(N_FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": f(HIDDEN, GATE), "U": f(HIDDEN, GATE), "w": f(GATE), "c": f(HIDDEN), "b": np.zeros(1)}

    def forward(self, x, starts):
        p = self.params
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        a = s / np.repeat(np.add.reduceat(s, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return x, h, t, g, a, z, y, sizes

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
        return self.forward(np.concatenate(bags).astype(np.float64), starts)[6]

    def gradients(self, x, starts, labels):
        p = self.params
        x, h, t, g, a, z, y, sizes = self.forward(x, starts)
        dy = (y - labels) / len(labels)
        out = {"c": z.T @ dy, "b": np.array([dy.sum()])}
        dz = np.repeat(dy[:, None] * p["c"], sizes, axis=0)
        da = (dz * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return out | {"w": (t * g).T @ ds, "V": h.T @ dt, "U": h.T @ dg, "E": x.T @ dh, "e": dh.sum(0)}


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 60, batch: int = 256, seed: int = 7) -> AttentionModel:
    """Adam on the log loss of whole bags. Without any label every score is 0.5."""
    rng = np.random.default_rng(seed)
    if not bags:
        model = AttentionModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), AttentionModel.initial(rng))
        model.params["c"] *= 0
        return model
    n = sum(map(len, bags))
    mean = sum(b.sum(0, dtype=np.float64) for b in bags) / n
    spread = np.sqrt(sum(((b.astype(np.float64) - mean) ** 2).sum(0) for b in bags) / n)
    model = AttentionModel(mean, spread + 0.02, AttentionModel.initial(rng))
    p, moments, step = model.params, {}, 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            own = [bags[i] for i in pick]
            starts = np.cumsum([0, *(len(b) for b in own[:-1])])
            step += 1
            for k, v in model.gradients(np.concatenate(own).astype(np.float64), starts, labels[pick]).items():
                v = v + 1e-4 * p[k]
                m, s = moments.get(k, (0.0, 0.0))
                moments[k] = m, s = 0.9 * m + 0.1 * v, 0.999 * s + 0.001 * v * v
                p[k] = p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", limit: int = FIT_DOCUMENTS) -> AttentionModel:
    """Fit on at most `limit` labelled documents, with all passages of each.

    Only doc_id (for the join with the labels) and the text are read; rows whose
    crc32(doc_id) mod 5 is 0 are never among them. Documents that repeat an id
    all count. Null texts are empty ones. Without labels, as of an empty table,
    every score is 0.5. Features come to the driver as halves of 16 bits.
    """

    @F.arrow_udf("binary")
    def flat(text: pa.Array) -> pa.Array:
        return pa.array([passage_features(x.as_py()).astype(np.float16).tobytes() for x in text], pa.binary())

    chosen = F.broadcast(bounded_labels(labels, column, limit))
    sample = docs.select("doc_id", text_bytes().alias("text")).join(chosen, "doc_id")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(limit)
    rows = sample.select("label", flat("text").alias("x")).toArrow()
    bags = [np.frombuffer(x.as_buffer(), np.float16).reshape(-1, N_FEATURES) for x in rows.column("x")]
    return train(bags, rows.column("label").to_numpy().astype(np.float64))


def score(model: AttentionModel, text: Column) -> Column:
    """The probability of label 1 for every whole text, from all its passages."""

    @F.arrow_udf(DoubleType())
    def own(texts: pa.Array) -> pa.Array:
        out, bags, held = [], [], 0
        for x in texts:
            bags.append(passage_features(x.as_py() or b""))
            held += len(bags[-1])
            if held >= 4096:
                out.append(model.score(bags))
                bags, held = [], 0
        if bags:
            out.append(model.score(bags))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return own(text)


def quality_scores(docs: DataFrame, model: AttentionModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with columns score and predicted (1 if score >= threshold).

    One row for each input row: null ids, repeated ids and null or empty texts
    are scored too, and of a text of any length every passage. Columns of docs
    that are called score or predicted give way. An empty table stays empty.
    """
    scored = docs.withColumn("score", score(model, text_bytes()))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
