"""Quality classifier: a byte-level convolutional network, written and trained in numpy.

A text is read as bytes. Every byte has a learned vector; filters of ``WIDTH`` bytes move
over the whole text in steps of ``STRIDE``. Chunks of ``CHUNK`` bytes that overlap by
``CHUNK - STEP`` each keep the highest answer of every filter, and the mean and the maximum
over all chunks are combined into one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR = 8
FILTERS = 24
STRIDE = 4
WIDTH = 2 * STRIDE
CHUNK = 1_024
STEP = 896
# At most this many labelled texts of each class, and chunks of each, are learned from.
SAMPLE_PER_CLASS = 1_000
SAMPLE_CHUNKS = 8
EPOCHS = 12
BATCH = 64
RATE = 0.004
# Chunks that scoring holds at a time: a long text never needs more memory than these.
BLOCK_CHUNKS = 256


@dataclass
class Model:
    vectors: np.ndarray  # (256, VECTOR)
    kernel: np.ndarray  # (WIDTH * VECTOR, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,): for the mean, then for the maximum
    bias: np.ndarray  # (1,)

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.kernel, self.shift, self.weights, self.bias]


def start(seed: int = 7) -> Model:
    draw = np.random.default_rng(seed)
    return Model(
        draw.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
        draw.normal(0, (WIDTH * VECTOR) ** -0.5, (WIDTH * VECTOR, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        np.zeros(2 * FILTERS, np.float32),
        np.zeros(1, np.float32),
    )


def answers(data: np.ndarray, model: Model) -> np.ndarray:
    """Filter answers (positions, FILTERS) of bytes whose number is a multiple of STRIDE."""
    rows = model.vectors[data].reshape(-1, STRIDE * VECTOR)
    half = STRIDE * VECTOR
    both = rows @ np.hstack([model.kernel[:half], model.kernel[half:]])
    return both[:-1, :FILTERS] + both[1:, FILTERS:] + model.shift


def padded(text: bytes) -> np.ndarray:
    """The bytes, with zeros up to a multiple of STRIDE and at least one filter's width."""
    size = max(-(-len(text) // STRIDE) * STRIDE, WIDTH)
    return np.frombuffer(text.ljust(size, b"\0"), np.uint8)


def pooled(text: bytes, model: Model) -> np.ndarray:
    """Mean and maximum over the chunks of each filter's highest answer, 0 at least."""
    data = padded(text)
    chunks = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    total = np.zeros(FILTERS)
    most = np.zeros(FILTERS, np.float32)
    for first in range(0, chunks, BLOCK_CHUNKS):
        count = min(BLOCK_CHUNKS, chunks - first)
        begin = first * STEP
        part = data[begin : begin + (count - 1) * STEP + CHUNK]
        found = answers(part, model)
        starts = np.arange(count) * (STEP // STRIDE)
        ends = np.minimum(starts + CHUNK // STRIDE - 1, len(found))
        top = np.array([found[s:e].max(0) for s, e in zip(starts, ends)])
        top = np.maximum(top, 0)
        total += top.sum(0)
        most = np.maximum(most, top.max(0))
    return np.concatenate([total / chunks, most])


def chance(text: bytes, model: Model) -> float:
    logit = float(pooled(text, model) @ model.weights + model.bias[0])
    return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def learn(texts: list[list[bytes]], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit the network to texts given as chunks (at most ``CHUNK`` bytes each), by Adam.

    Classes weigh the same. The gradient of a maximum flows to the place that held it.
    With one class only, or no rows, the answer is that class's (or an even) chance.
    """
    model = start(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    if len(set(labels.tolist())) < 2:
        model.bias[:] = np.log(share / (1 - share))
        return model
    draw = np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    size = CHUNK // STRIDE
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parts()]
    step = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            step += 1
            picked = order[at : at + BATCH]
            chunks = [c for i in picked for c in texts[i]]
            owner = np.repeat(np.arange(len(picked)), [len(texts[i]) for i in picked])
            data = np.zeros((len(chunks), CHUNK), np.uint8)
            lengths = np.empty(len(chunks), int)
            for row, c in zip(data, chunks):
                row[: len(c)] = np.frombuffer(c, np.uint8)
            lengths[:] = [max(-(-len(c) // STRIDE) * STRIDE, WIDTH) for c in chunks]
            rows = model.vectors[data].reshape(len(chunks), size, STRIDE * VECTOR)
            half = STRIDE * VECTOR
            first = rows @ model.kernel[:half]
            second = rows @ model.kernel[half:]
            found = first[:, :-1] + second[:, 1:] + model.shift
            outside = np.arange(size - 1)[None, :] >= (lengths // STRIDE - 1)[:, None]
            found[outside] = -1e9
            place = found.argmax(1)
            top = np.take_along_axis(found, place[:, None, :], 1)[:, 0]
            open_ = top > 0
            top = np.maximum(top, 0)
            count = np.bincount(owner, minlength=len(picked))[:, None]
            mean = np.zeros((len(picked), FILTERS), np.float32)
            np.add.at(mean, owner, top)
            mean /= count
            most = np.zeros_like(mean)
            np.maximum.at(most, owner, top)
            features = np.hstack([mean, most])
            logit = features @ model.weights + model.bias[0]
            miss = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels[picked]) * weight[picked]
            miss = (miss / len(picked)).astype(np.float32)
            d_features = miss[:, None] * model.weights[None, :]
            d_top = d_features[owner, :FILTERS] / count[owner]
            d_top += d_features[owner, FILTERS:] * (top == most[owner])
            d_top *= open_
            # Where each filter's highest answer came from: WIDTH bytes per chunk and filter.
            spots = place[:, :, None] * STRIDE + np.arange(WIDTH)
            seen = np.take_along_axis(data[:, None, :], spots, 2)
            patches = model.vectors[seen].reshape(len(chunks), FILTERS, WIDTH * VECTOR)
            d_kernel = np.einsum("cf,cfk->kf", d_top, patches)
            d_patch = d_top[:, :, None] * model.kernel.T[None]
            d_vectors = np.zeros_like(model.vectors)
            np.add.at(d_vectors, seen.ravel(), d_patch.reshape(-1, VECTOR))
            d_vectors[0] = 0
            slopes = [
                d_vectors,
                d_kernel,
                d_top.sum(0),
                features.T @ miss + 1e-4 * model.weights,
                np.array([miss.sum()], np.float32),
            ]
            for part, slope, (m, v) in zip(model.parts(), slopes, moments):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                part -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def is_held_out(ident: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is as ''."""
    text = F.coalesce(ident.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def sample(
    docs: DataFrame,
    labels: DataFrame,
    ident: str,
    text: str,
    label: str,
    per_class: int = SAMPLE_PER_CLASS,
) -> tuple[list[list[bytes]], np.ndarray]:
    """Labelled texts to learn from, none of them held out, as evenly spaced chunks.

    At most ``per_class`` rows of each class reach the driver, picked by a hash of the id,
    with at most ``SAMPLE_CHUNKS`` chunks of a text: 16 MB in all.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(ident).isNotNull())
    known = known.filter(~is_held_out(F.col(ident))).select(ident, F.col(label).alias("_label"))
    order = [F.xxhash64(F.lit("learn"), F.col(ident)), F.col(ident)]
    picked = [known.filter(F.col("_label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    chosen = picked[0].union(picked[1]).dropDuplicates([ident])
    body = F.coalesce(F.col(text), F.lit(""))
    pieces = F.least(F.lit(SAMPLE_CHUNKS), F.ceil(F.length(body) / CHUNK)).cast("int")
    pieces = F.greatest(pieces, F.lit(1))
    gap = F.greatest(F.length(body) - CHUNK, F.lit(0)) / F.greatest(pieces - 1, F.lit(1))
    cuts = F.transform(
        F.sequence(F.lit(0), pieces - 1),
        lambda i: F.substring(body, F.floor(i * gap).cast("int") + 1, F.lit(CHUNK)),
    )
    # At most 2 * per_class ids: small enough to send along, whatever the tables' size.
    rows = (
        docs.select(ident, text)
        .join(F.broadcast(chosen), ident)
        .select(ident, cuts.alias("cuts"), F.col("_label").cast("int").alias("y"))
        .dropDuplicates([ident])
        .limit(2 * per_class)
        .collect()
    )
    rows.sort(key=lambda r: str(r[ident]))
    texts = [[c.encode()[:CHUNK] for c in r["cuts"]] for r in rows]
    return texts, np.array([r["y"] for r in rows], int)


def score(text: Column, model: Model) -> Column:
    """The chance that a text has label 1; null and empty texts get that of no evidence."""

    @F.arrow_udf("double")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array([chance(t.as_py() or b"", model) for t in texts], pa.float64())

    return measure(text.cast("binary"))


def classified(
    docs: DataFrame,
    labels: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    The network learns from a bounded sample of labelled rows that are not held out, and
    then scores every whole text; only the text goes into a score, so equal texts score
    the same. Null texts are empty. Labels other than 0 and 1 and null ids are not learned
    from. Without labels every score is 0.5. An empty table gives an empty result; other
    columns are not looked at.
    """
    model = learn(*sample(docs, labels, ident, text, label))
    scored = docs.select(
        F.col(ident),
        is_held_out(F.col(ident)).alias("held_out"),
        score(F.col(text), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
