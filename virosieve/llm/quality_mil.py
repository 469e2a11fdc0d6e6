"""Document quality by attention-based multiple-instance learning over passages.

A document is a bag of passages, labelled as a whole. Each passage is encoded (``passages``), mapped to a
hidden vector, and weighed by gated attention: ``w . (tanh(V h) * sigmoid(U h))``, a softmax within the
document. The weighted sum of the hidden vectors gives the score. All parameters are learned together by
Adam on the log loss.

Fitting uses at most ``sample`` labelled documents, those with the least hash of their id, with all their
passages; that bound is what the driver holds. Scoring is one pass without a shuffle over whole texts.

Nulls: a null or empty text is one passage of zeros and is scored like any other. Labels that are null, or
not 0 or 1, are left out; a document with several labels counts as 1 if one of them is. Without labelled
documents every score is 0.5. Repeated rows stay repeated, also when fitting. Only the id and text columns
are read; ``kept_rows`` returns all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from virosieve.llm.passages import DIMENSION, passages
from virosieve.llm.text import column, id_remainder, small_batches, tidy

SAMPLE = 6000
HIDDEN, GATE = 16, 8


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict

    def scores(self, vectors: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(first), 0.5)
        return self.forward((vectors - self.mean) / self.scale, first)["score"]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p = self.parts
        sizes = np.diff(np.append(first, len(x)))
        hidden = np.tanh(x @ p["W"] + p["b"])
        tan, gate = np.tanh(hidden @ p["V"]), _sigmoid(hidden @ p["U"])
        raw = (tan * gate) @ p["w"]
        weight = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first), sizes))
        weight /= np.repeat(np.add.reduceat(weight, first), sizes)
        pooled = np.add.reduceat(hidden * weight[:, None], first)
        score = _sigmoid(pooled @ p["c"] + p["d"])
        return {"hidden": hidden, "tan": tan, "gate": gate, "weight": weight, "pooled": pooled, "score": score, "sizes": sizes}

    def gradients(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict:
        p, f = self.parts, self.forward(x, first)
        d_out = (f["score"] - labels) / len(labels)
        d_pooled = np.repeat(d_out[:, None] * p["c"], f["sizes"], axis=0)
        gain = (f["hidden"] * d_pooled).sum(axis=1)  # of each passage's weight
        d_raw = f["weight"] * (gain - np.repeat(np.add.reduceat(f["weight"] * gain, first), f["sizes"]))
        d_tan = d_raw[:, None] * p["w"] * f["gate"] * (1 - f["tan"] ** 2)
        d_gate = d_raw[:, None] * p["w"] * f["tan"] * f["gate"] * (1 - f["gate"])
        d_hidden = d_pooled * f["weight"][:, None] + d_tan @ p["V"].T + d_gate @ p["U"].T
        d_in = d_hidden * (1 - f["hidden"] ** 2)
        return {
            "W": x.T @ d_in,
            "b": d_in.sum(axis=0),
            "V": f["hidden"].T @ d_tan,
            "U": f["hidden"].T @ d_gate,
            "w": (f["tan"] * f["gate"]).T @ d_raw,
            "c": f["pooled"].T @ d_out,
            "d": d_out.sum(),
        }


def fit_arrays(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 25, batch: int = 256, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """The model fitted to bags of passage vectors."""
    if not bags:
        return Model(np.zeros(DIMENSION), np.ones(DIMENSION), {})
    stacked = np.concatenate(bags).astype(np.float64)
    mean, scale = stacked.mean(axis=0), stacked.std(axis=0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    rng = np.random.default_rng(11)
    share = np.clip(labels.mean(), 0.01, 0.99)
    parts = {
        "W": rng.normal(0, DIMENSION**-0.5, (DIMENSION, HIDDEN)),
        "b": np.zeros(HIDDEN),
        "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "w": rng.normal(0, GATE**-0.5, GATE),
        "c": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "d": np.array(np.log(share / (1 - share))),
    }
    model = Model(mean, scale, parts)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in parts.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for start in range(0, len(order), batch):
            chosen = order[start : start + batch]
            sizes = np.array([len(bags[i]) for i in chosen])
            first = np.cumsum(sizes) - sizes
            slopes = model.gradients(np.concatenate([bags[i] for i in chosen]), first, labels[chosen])
            step += 1
            for k, slope in slopes.items():
                m, v = moments[k]
                slope = slope + decay * parts[k]
                m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
                moments[k] = (m, v)
                parts[k] = parts[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn_from=None, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from the labelled ``docs`` for which the Column ``learn_from`` (over ``id``) holds."""
    marked = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("label"))
    marked = marked.filter("id is not null and label in (0, 1)")
    if learn_from is not None:
        marked = marked.filter(learn_from)
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    texts = texts.filter("id is not null").withColumn("digest", F.xxhash64("text"))
    # rows that share an id count by their texts, so the bound holds for what is learned from, not only for ids
    several = texts.select("id", "digest").join(marked.select("id"), "id", "left_semi").distinct()
    chosen = several.join(marked, "id").orderBy(F.xxhash64("id"), "id", "digest").limit(sample).collect()
    if not chosen:
        return fit_arrays([], np.zeros(0))
    marks = {r["id"]: r["label"] for r in chosen}
    pairs = docs.sparkSession.createDataFrame([(r["id"], r["digest"]) for r in chosen], "id long, digest long")
    small = F.broadcast(pairs)  # at most ``sample`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            vectors, first = passages(column(batch, "text"))
            bags = [b.astype(np.float32).tobytes() for b in np.split(vectors, first[1:])]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "digest"), pa.array(bags, pa.binary())], names=["id", "digest", "bag"])

    bagged = texts.join(small, ["id", "digest"]).mapInArrow(run, "id long, digest long, bag binary")
    rows = bagged.groupBy("id", "digest").agg(F.min("bag").alias("bag")).collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["bag"])))  # the same model whatever the partitions
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, DIMENSION) for r in rows]
    return fit_arrays(bags, np.array([marks[r["id"]] for r in rows], float))


def scored(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` as a struct column ``row``, with ``score``."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    packed = packed.withColumn("text", F.col("row").getField(text_column).cast("string"))
    schema = packed.select("row").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            score = model.scores(*passages(column(batch, "text")))
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(score, pa.float64())], names=["row", "score"])

    return packed.mapInArrow(tidy(run), schema)


def held_out(id_column: str = "doc_id"):
    return id_remainder(id_column, 3) == 1


def kept_rows(docs: DataFrame, labels: DataFrame, least: float = 0.5, text_column: str = "text", examples: DataFrame | None = None, **columns: str) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with their own columns; learns from ``examples``, or ``docs``."""
    model = fit(docs if examples is None else examples, labels, ~held_out("id"), text_column=text_column, **columns)
    return scored(docs, model, text_column).filter(F.col("score") >= least).select("row.*")
