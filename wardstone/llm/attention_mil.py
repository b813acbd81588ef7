"""Quality classifier by attention over passages.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded as a vector (shares of kinds of bytes, word
lengths, repetition, hashed words), projected to ``HIDDEN`` units, and given a gated attention weight; the weighted sum of
the passages is scored. Encoder, attention and score are learned together from document labels alone.

Training takes a bounded sample: at most ``SAMPLE`` labelled rows outside the held-out fold, in order of a hash of their
id, in one task. Scoring streams every whole text past the weights (a few thousand numbers, sent to the tasks).

The fold: crc32 of doc_id as text, modulo 5; 0 is held out and never learned from. Rows without doc_id are never learned
from and not held out. Null and empty texts are one empty passage and get a score. Several labels of one id: the largest.
Without any usable label all scores are 0.5. Scores depend on the text only, so repeated rows agree; only doc_id and text
are read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm import bytesops as B

PASSAGE = 50
BUCKETS = 32
HIDDEN = 24
GATE = 12
SAMPLE = 4000
EPOCHS = 60
KINDS = 10


def _kinds() -> np.ndarray:
    kind = np.full(256, 9, np.int64)
    kind[128:] = 0
    kind[97:123], kind[65:91], kind[48:58] = 1, 2, 3
    for i, signs in enumerate(("|", "!?", "#*$%&<>^~_=+@\\", ".,;:", "()[]{}\"'/-`")):
        kind[list(signs.encode())] = 4 + i
    return kind


KIND = _kinds()
FEATURES = KINDS + 4 + BUCKETS


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages and the numbers of their texts; every text has at least one passage."""
    data, at = B.buffer_of(texts)
    starts, stops, number = B.word_bounds(data, at, B.SPACED)
    n = len(texts)
    counts = np.bincount(number, minlength=n) if len(number) else np.zeros(n, np.int64)
    parts = np.maximum(1, -(-counts // PASSAGE))
    base = np.concatenate([[0], np.cumsum(parts)])
    owner = np.repeat(np.arange(n), parts)
    out = np.zeros((base[-1], FEATURES), np.float32)
    if not len(starts):
        return out, owner
    nth = np.arange(len(starts)) - np.concatenate([[0], np.cumsum(counts)])[number]
    passage = base[number] + nth // PASSAGE
    words = B.word_hashes(B.LOWER[data], starts, stops)
    length = (stops - starts).astype(np.float64)
    total = np.bincount(passage, length, len(out))
    many = np.bincount(passage, minlength=len(out)).astype(np.float64)
    safe, few = np.maximum(total, 1), np.maximum(many, 1)
    # kinds of bytes inside words, by differences of running counts
    for kind in range(KINDS):
        run = np.concatenate([[0], np.cumsum(KIND[data] == kind)])
        out[:, kind] = np.bincount(passage, run[stops] - run[starts], len(out)) / safe
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (passage[1:] == passage[:-1])
    out[:, KINDS] = np.bincount(passage, same, len(out)) / few
    # distinct words of a passage; sorting one number is much cheaper than sorting pairs
    _, one = np.unique(B.mix(words + B.mix(passage.astype(B.U))), return_index=True)
    out[:, KINDS + 1] = np.bincount(passage[one], minlength=len(out)) / few
    out[:, KINDS + 2] = total / few / 10
    out[:, KINDS + 3] = np.log1p(many) / 4
    bucket = (words >> B.U(59)).astype(np.int64)
    out[:, KINDS + 4 :] = (np.bincount(passage * BUCKETS + bucket, minlength=len(out) * BUCKETS).reshape(-1, BUCKETS)
                           / few[:, None] * 4)
    return out, owner


def _segment_sum(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, edges[:-1], axis=0)


def forward(w: dict, x: np.ndarray, owner: np.ndarray):
    """Scores of the texts and what the gradient needs."""
    edges = np.searchsorted(owner, np.arange(owner[-1] + 2))
    x = (x - w["mean"]) / w["scale"]
    h = np.tanh(x @ w["W"] + w["b"])
    v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
    e = (v * u) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, edges[:-1]), np.diff(edges)))
    attention = e / np.repeat(_segment_sum(e, edges), np.diff(edges))
    z = _segment_sum(h * attention[:, None], edges)
    score = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return score, (x, h, v, u, attention, z, edges)


def gradients(w: dict, state, delta: np.ndarray) -> dict:
    """``delta``: of the logits, one for each text."""
    x, h, v, u, attention, z, edges = state
    n = np.diff(edges)
    dz = np.repeat(delta[:, None] * w["c"], n, axis=0)
    each = (h * dz).sum(1)
    mean = np.repeat(_segment_sum(each * attention, edges), n)
    de = attention * (each - mean)
    dv, du = de[:, None] * w["a"] * u * (1 - v**2), de[:, None] * w["a"] * v * u * (1 - u)
    dh = (dz * attention[:, None] + dv @ w["V"].T + du @ w["U"].T) * (1 - h**2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ de, "c": z.T @ delta, "d": delta.sum()}


def fit(x: np.ndarray, owner: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> dict:
    """Weights by Adam over batches of texts; both labels weigh the same."""
    rng = np.random.default_rng(7)
    w = {"W": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)),
         "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(())}
    fixed = {"mean": x.mean(0), "scale": x.std(0) + 1e-3}
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6))
    edges = np.searchsorted(owner, np.arange(len(label) + 1))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for i in range(0, len(order), 128):
            batch = order[i : i + 128]
            rows = np.concatenate([np.arange(edges[j], edges[j + 1]) for j in batch])
            own = np.repeat(np.arange(len(batch)), edges[batch + 1] - edges[batch])
            score, state = forward(w | fixed, x[rows], own)
            grad = gradients(w, state, weight[batch] * (score - label[batch]) / len(batch))
            step += 1
            for k, g in grad.items():
                g = g + 1e-4 * w[k]
                m, s = moments[k]
                m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g**2
                moments[k] = m, s
                w[k] = w[k] - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w | fixed


def fold_of(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict | None:
    """Weights learned in one task from at most ``sample`` labelled texts outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    known = known.where(fold_of(F.col("doc_id")) != 0).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(known, "doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "text").limit(sample)

    def learn(batches):
        batches = list(batches)
        if sum(b.num_rows for b in batches):
            t = pa.Table.from_batches(batches)
            parts = [encode(t.column("text").combine_chunks().slice(i, 256)) for i in range(0, t.num_rows, 256)]
            owner = np.concatenate([o + 256 * i for i, (_, o) in enumerate(parts)])
            w = fit(np.concatenate([x for x, _ in parts]).astype(np.float64), owner, t.column("label").to_numpy().astype(float))
            yield pa.RecordBatch.from_pydict({"w": pa.array([pickle.dumps(w)], pa.binary())})

    got = rows.coalesce(1).mapInArrow(learn, "w binary").collect()
    return pickle.loads(got[0]["w"]) if got else None


def scored(docs: DataFrame, weights: dict | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                s = np.full(part.num_rows, 0.5)
                if sent.value is not None:
                    s, _ = forward(sent.value, *encode(part.column("text")))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "score": pa.array(s, pa.float64())})

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
