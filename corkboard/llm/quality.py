"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by class log-count ratios (NB-SVM)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from corkboard.llm.common import bounded_sample, row_blocks, trimmed, utf8
from corkboard.llm.kernels import byte_grams, words

BITS = 18
GRAMS = (3, 5)
#: The model is fitted on about this many labelled rows at most, drawn by a hash of doc_id.
MOST_LABELLED = 6_000
THRESHOLD = 0.7


@dataclass
class Model:
    """weights: by feature, the log-count ratio times what the linear model gives it; ratio: the log-count ratios, for a
    row's length. slope and offset turn a margin into a probability."""

    weights: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float


class _Distinct:
    """Marks one of each value without sorting: of all places of a value, the last written stays."""

    def __init__(self, size: int):
        self.slot = np.zeros(size, np.int32)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        at = np.arange(len(values), dtype=np.int32)
        self.slot[values] = at
        return values[self.slot[values] == at]


def _row_features(data: np.ndarray, distinct: _Distinct) -> np.ndarray:
    """Distinct features of one text: buckets of its byte n-grams."""
    return distinct(np.concatenate([byte_grams(data, n, BITS - 1) + np.uint32(k << (BITS - 1)) for k, n in enumerate(GRAMS)]))


#: Word pairs fall into two kinds, seen before or not, and of one word twice or not; each share is told by as many
#: indicators as it has 32nds, so that a repetitive text differs in many of them.
STEPS = 32
SIZE = (1 << BITS) + 1 + 2 * STEPS


def _repeats(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Indicators of the shares of repeated word pairs and of words that follow themselves; one more for a text without words."""
    h, bounds = words(data, offsets)
    base, out = 1 << BITS, []
    for i in range(len(offsets) - 1):
        own = h[bounds[i] : bounds[i + 1]]
        if not len(own):
            out.append(np.array([base], np.uint32))
            continue
        pairs = own[:-1] * np.uint64(3) + own[1:]
        n = max(1, len(pairs))
        shares = (1 - len(np.unique(pairs)) / n if len(pairs) else 0.0, float((own[1:] == own[:-1]).sum()) / n)
        out.append(np.concatenate([base + 1 + k * STEPS + np.arange(int(np.ceil(x * STEPS))) for k, x in enumerate(shares)]).astype(np.uint32))
    return out


def features(data: np.ndarray, offsets: np.ndarray, distinct: _Distinct):
    """The feature ids of each row, as indicators: each once."""
    extra = _repeats(data, offsets)
    for i in range(len(offsets) - 1):
        yield np.concatenate([_row_features(data[offsets[i] : offsets[i + 1]], distinct), extra[i]])


@trimmed
def _features_of(batches):
    distinct = _Distinct(SIZE)
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for first, end in row_blocks(offsets):
            ids = [x.astype(np.int32).tobytes() for x in features(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first], distinct)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), batch.column("label").slice(first, end - first)], names=["ids", "label"])


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM: each step solves one row's dual variable, between 0 and its cost. A row's vector is `values`
    at its features, scaled to unit length; classes weigh the same in all."""
    w, bias = np.zeros(len(values)), 0.0
    scale = np.array([1 / max(1e-9, np.sqrt((values[r] ** 2).sum() + 1)) for r in rows])
    most = cost * np.where(y > 0, 0.5 / max(1e-9, (y > 0).mean()), 0.5 / max(1e-9, (y < 0).mean()))
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, s = rows[i], scale[i]
            v = values[r]
            gradient = y[i] * s * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient, 0.0), most[i])  # the row's vector has length 1
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i] * s
                w[r] += step * v
                bias += step
                moved += abs(new - alpha[i])
                alpha[i] = new
        if moved < 1e-3 * len(rows) * cost:
            break
    return w, bias


def _calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of best likelihood (Newton's method, with smoothed targets)."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        v = p * (1 - p)
        hessian = np.array([[(v * margins**2).sum(), (v * margins).sum()], [(v * margins).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(labelled: DataFrame, most: int = MOST_LABELLED, cost: float = 1.0, rounds: int = 12, seed: int = 5) -> Model:
    """Fit on (doc_id, text, label 0 or 1); rows of another or no label don't count. On a sample of about `most` rows.
    Four fifths fit the hinge-loss model, the rest its probabilities. Without both classes, every score is the share of label 1."""
    sample = bounded_sample(labelled.filter(F.col("label").isin(0, 1)), F.col("doc_id"), most, seed)
    found = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(_features_of, "ids binary, label int").toPandas()
    found = found.sort_values(["ids", "label"], kind="stable").reset_index(drop=True)  # the same model whatever order rows came in
    rows = [np.frombuffer(x, np.int32) for x in found["ids"]]
    y = np.where(found["label"].to_numpy() == 1, 1.0, -1.0) if len(rows) else np.zeros(0)
    if not len(rows) or abs(y.sum()) == len(rows):
        share = float((y > 0).mean()) if len(rows) else 0.5
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    held = np.random.default_rng(seed).random(len(rows)) < 0.2
    counts = {c: np.ones(SIZE) for c in (1.0, -1.0)}
    for r, c, h in zip(rows, y, held, strict=True):
        if not h:
            counts[c][r] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    fitted = np.flatnonzero(~held)
    w, bias = dual_coordinate_descent([rows[i] for i in fitted], ratio, y[fitted], cost, rounds, seed)
    weights = w * ratio
    scaled = np.array([margin(r, weights, bias, ratio) for r in rows])
    use = held if held.any() and len(set(y[held])) == 2 else np.ones(len(rows), bool)
    slope, offset = _calibrated(scaled[use], y[use])
    return Model(weights, ratio, bias, slope, offset)


def margin(row: np.ndarray, weights: np.ndarray, bias: float, ratio: np.ndarray) -> float:
    return (weights[row].sum() + bias) / np.sqrt((ratio[row] ** 2).sum() + 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= THRESHOLD) added. Null text counts
    as empty; an empty text gets a score as any other. Columns named score or predicted are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.ratio.astype(np.float32), model.bias, model.slope, model.offset))
    kept = docs.drop("score", "predicted")

    @trimmed
    def scored(batches):
        weights, ratio, bias, slope, offset = shared.value
        squares = ratio**2
        distinct = _Distinct(SIZE)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = []
            for first, end in row_blocks(offsets):
                for ids in features(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first], distinct):
                    m = (float(weights[ids].sum(dtype=np.float64)) + bias) / np.sqrt(float(squares[ids].sum(dtype=np.float64)) + 1)
                    out.append(1 / (1 + np.exp(-min(max(slope * m + offset, -30), 30))))
            s = np.array(out, np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = StructType([*kept.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())
    return kept.mapInArrow(scored, schema)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the documents that have a quality label."""
    return docs.select("doc_id", "text").join(labels.select("doc_id", F.col("quality").alias("label")).filter(F.col("label").isNotNull()), "doc_id")
