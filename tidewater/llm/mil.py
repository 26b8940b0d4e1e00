"""Quality classifier: attention-based multiple-instance learning over a text's passages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.quality_rules import CLASSES, _class_table
from tidewater.llm.shared import byte_slices, stored, unstored

#: Words of a passage, and buckets of hashed words in its features.
PASSAGE, BUCKETS = 64, 16
#: Labelled texts that the model is fitted on, about, by a draw of each row, and passages of all of them at most, some 54 MB:
#: a bound on the labelled rows that are drawn. Each that is drawn teaches with all its passages.
SAMPLE, SAMPLE_PASSAGES = 6000, 384_000
#: Characters that features are made of at once, some 18 MB of arrays, and of a word; a longer run counts as several words.
BLOCK, LONGEST = 250_000, 4000
#: Sizes of a passage's representation and of its attention; steps of the training, their rate and decay, and the texts of each.
HIDDEN, ATTENTION, STEPS, RATE, DECAY, STEP = 24, 12, 1200, 0.01, 1e-3, 128

_SPACE = CLASSES.index("space")
#: Marks that features count by themselves.
_MARKS = "|!*.,"
N_FEATURES = len(CLASSES) - 1 + len(_MARKS) + BUCKETS + 7


_WORD, _LONG_RUN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"([^\x20\x09-\x0D]{%d})(?=[^\x20\x09-\x0D])" % LONGEST)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, one text after another, and the number of passages of each.

    A passage is a run of PASSAGE words; a text without words has one empty passage. Counts are made over about BLOCK
    characters at once: several texts, or the passages of a part of one, so a text of any length takes no more memory.
    """
    features, per_text = [np.zeros((0, N_FEATURES), np.float32)], np.zeros(len(texts), np.int64)
    now: list[tuple[int, str]] = []
    held = 0

    def done() -> None:
        x, counts = _encode([part for _, part in now])
        features.append(x)
        np.add.at(per_text, [i for i, _ in now], counts)
        now.clear()

    for i, text in enumerate(texts):
        for part in _blocks(text):
            if now and held + len(part) > BLOCK:
                done()
                held = 0
            now.append((i, part))
            held += len(part)
    if now:
        done()
    return np.concatenate(features), per_text


def _blocks(text: str) -> Iterator[str]:
    """A text in parts of whole passages, BLOCK characters or a passage each; most texts are one."""
    text = _LONG_RUN.sub(r"\1 ", text) if len(text) > LONGEST else text
    start = n = 0
    for m in _WORD.finditer(text) if len(text) > BLOCK else ():
        n += 1
        if n % PASSAGE == 0 and m.end() - start >= BLOCK // 2:
            yield text[start : m.end()]
            start = m.end()
    if not start or _WORD.search(text, start):
        yield text[start:]


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of some texts; all counts are made on arrays of code points, words and passages."""
    points = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    kinds = _class_table()[points]
    solid = kinds != _SPACE
    owner = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    first = solid & ~np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
    n_words = np.bincount(owner[starts], minlength=len(texts))
    per_text = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(per_text) - per_text
    rank = np.arange(len(starts)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    passage = np.repeat(base, n_words) + rank // PASSAGE  # of each word
    total = int(per_text.sum())
    word_of = np.cumsum(first) - 1  # of each solid code point
    at = passage[word_of[solid]] if len(starts) else np.zeros(0, np.int64)
    own, own_points = kinds[solid], points[solid]
    count = lambda where, weight=None: np.bincount(where, weight, minlength=total).astype(float)
    chars, words = np.maximum(1, count(at)), np.maximum(1, count(passage))
    columns = [count(at[own == k]) / chars for k in range(len(CLASSES)) if k != _SPACE]
    columns += [count(at[own_points == ord(c)]) / words for c in _MARKS]
    # Words by a hash of their letters and places.
    lengths = ends - starts
    place = np.arange(len(own_points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    mixed = (own_points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = np.add.reduceat(mixed, np.cumsum(lengths) - lengths) if len(starts) else np.zeros(0, np.uint64)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    bucket = (hashes >> np.uint64(60)).astype(np.int64)
    columns += [count(passage[bucket == b]) / words for b in range(BUCKETS)]
    key = np.stack([passage.astype(np.uint64), hashes]) if len(starts) else np.zeros((2, 0), np.uint64)
    order = np.lexsort((key[1], key[0]))
    fresh = np.concatenate([[True], (key[:, order][:, 1:] != key[:, order][:, :-1]).any(axis=0)])[: len(order)]
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])])[: len(hashes)]
    upper = np.add.reduceat((own == CLASSES.index("upper")).astype(np.int64), np.cumsum(lengths) - lengths) if len(starts) else lengths
    columns += [
        count(passage[order[fresh]]) / words,  # different words
        count(passage[again]) / words,  # repeats of the word before
        chars / words / 10,
        np.sqrt(np.maximum(0, count(passage, lengths.astype(float) ** 2) / words - (chars / words) ** 2)) / 10,
        count(passage[(upper == lengths) & (lengths > 1)]) / words,
        count(passage[lengths <= 3]) / words,
        np.minimum(words, PASSAGE) / PASSAGE,
    ]
    return np.stack(columns, axis=1).astype(np.float32), per_text


class Model:
    """Gated attention over passages; all weights are small arrays."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    def forward(self, x: np.ndarray, per_text: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        starts = np.cumsum(per_text) - per_text
        z = (x - w["mean"]) / w["scale"]
        h = np.maximum(0, z @ w["embed"] + w["embed_0"])
        v, u = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-np.clip(h @ w["gate"], -30, 30)))
        e = (v * u) @ w["attend"]
        top = np.maximum.reduceat(e, starts)
        a = np.exp(e - np.repeat(top, per_text))
        a /= np.repeat(np.add.reduceat(a, starts), per_text)
        pooled = np.add.reduceat(a[:, None] * h, starts, axis=0)
        logit = pooled @ w["score"] + w["score_0"]
        return {"z": z, "h": h, "v": v, "u": u, "a": a, "pooled": pooled, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def score(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return self.forward(x, per_text)["p"]

    def gradients(self, x: np.ndarray, per_text: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        w, f = self.weights, self.forward(x, per_text)
        d = (f["p"] - y) / len(y)
        pooled = np.repeat(d[:, None] * w["score"], per_text, axis=0)  # of each passage's text
        da = (pooled * f["h"]).sum(axis=1)
        mean = np.repeat(np.add.reduceat(f["a"] * da, np.cumsum(per_text) - per_text), per_text)
        de = f["a"] * (da - mean)
        dv, du = de[:, None] * w["attend"] * f["u"] * (1 - f["v"] ** 2), de[:, None] * w["attend"] * f["v"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * pooled + dv @ w["tanh"].T + du @ w["gate"].T
        dz = dh * (f["h"] > 0)
        return {"score": f["pooled"].T @ d, "score_0": d.sum(), "attend": (f["v"] * f["u"]).T @ de, "tanh": f["h"].T @ dv, "gate": f["h"].T @ du, "embed": f["z"].T @ dz, "embed_0": dz.sum(axis=0)}


def train(x: np.ndarray, per_text: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
    """Fits the weights by Adam on steps of whole texts. Without texts of both labels the score is the share of label 1."""
    rng = np.random.default_rng(seed)
    rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    weights = {
        "mean": x.mean(axis=0, dtype=np.float64) if len(x) else np.zeros(N_FEATURES),
        "scale": x.std(axis=0, dtype=np.float64) + 1e-3 if len(x) else np.ones(N_FEATURES),
        "embed": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)),
        "embed_0": np.zeros(HIDDEN),
        "tanh": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "attend": rng.normal(0, ATTENTION**-0.5, ATTENTION),
        "score": np.zeros(HIDDEN),
        "score_0": np.log(rate / (1 - rate)),
    }
    model, starts = Model(weights), np.cumsum(per_text) - per_text
    if not 0 < y.sum() < len(y):
        return model
    means = {k: np.zeros_like(v) for k, v in weights.items()}
    squares, step = {k: np.zeros_like(v) for k, v in weights.items()}, 0
    order = np.zeros(0, np.int64)
    while step < STEPS:
        if not len(order):
            order = rng.permutation(len(y))
        take, order = order[:STEP], order[STEP:]
        rows = np.concatenate([np.arange(starts[i], starts[i] + per_text[i]) for i in take])
        step += 1
        for k, g in model.gradients(x[rows], per_text[take], y[take]).items():
            g = g + (DECAY * weights[k] if k not in ("embed_0", "score_0") else 0)
            means[k] = 0.9 * means[k] + 0.1 * g
            squares[k] = 0.999 * squares[k] + 0.001 * g * g
            weights[k] = weights[k] - RATE * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in byte_slices(batches):
        x, per_text = encode([t.decode("utf-8", "replace") for t in texts])
        ends = np.cumsum(per_text)
        rows = [x[e - n : e].tobytes() for e, n in zip(ends, per_text, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(per_text), pa.array(rows, pa.binary())], names=["doc_id", "label", "n", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> Model:
    """A model fitted on about `sample` of the texts of `docs` (doc_id, text) that `labels` (doc_id, label 0 or 1) names.

    Rows are drawn by a hash of their ids, and of these, in the order of the hash, each whose passages still fit into
    `passages`; a text that is drawn teaches with all its passages. Only their features reach the driver. Null labels and
    ids count as none; a null text is empty. A doc_id teaches once, however often it stands in either table: by the
    greatest of its labels, and by that of its texts with the fewest passages whose features come first. Without texts of
    both labels every score is the share of label 1.
    """
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("label").cast("long")).alias("label"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    drawn = known.where(draw < min(1.0, sample / max(1, n)))
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    encoded = joined.mapInArrow(_encoded, "doc_id long, label long, n long, x binary")
    encoded = stored(encoded.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.struct("n", "x")).alias("own")).select("doc_id", "label", "own.*"), "fit-passages")
    taken, left = [], passages
    for doc_id, size in encoded.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "n").toLocalIterator():
        if size <= left:
            taken.append(doc_id)
            left -= size
    rows = sorted(encoded.where(F.col("doc_id").isin(taken)).select("doc_id", "label", "x").collect())
    unstored(encoded)
    parts = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in rows]
    x = np.concatenate(parts) if parts else np.zeros((0, N_FEATURES), np.float32)
    return train(x, np.array([len(p) for p in parts], np.int64), np.array([r.label for r in rows], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_passages) for every row of `docs` (doc_id, text). Only the text is read, whole and whatever its length.

    A null text counts as empty; a text without words has one passage; a run of over 4,000 characters without white space
    counts as several words. Each row is scored by itself: equal texts have
    equal scores, as repeated rows have. Other columns may have any names; an empty table gives no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches):
            x, per_text = encode([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x, per_text), pa.float64()), pa.array(per_text, pa.int32())], names=["doc_id", "score", "n_passages"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.IntegerType())])
    return docs.select("doc_id", "text").mapInArrow(each, schema)
