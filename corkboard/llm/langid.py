"""Language identification: multinomial naive Bayes over hashed character n-grams, texts scored many at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from corkboard.llm.common import bounded_sample, row_blocks

BITS = 15
GRAMS = (1, 2, 3)
#: The model is fitted on about this many labelled rows at most, drawn by a hash of doc_id.
MOST_LABELLED = 12_000
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length in GRAMS: the texts' n-grams as hash buckets, and the text that each is of, ascending. Texts are
    lower-cased and each run of others than letters is one space; none of a text without letters."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(lower)), np.fromiter(map(len, lower), np.int64, len(lower)))
    letter = _is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])
    points, row = np.where(letter, points, np.uint32(32))[keep], row[keep]
    out = []
    for n in GRAMS:
        size = max(0, len(points) - n + 1)
        h = np.full(size, 0x811C9DC5 + n, np.uint32)
        for k in range(n):
            h ^= points[k : k + size]
            h *= np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        own = row[:size] == row[n - 1 : n - 1 + size]
        out.append(((h >> np.uint32(32 - BITS))[own], row[:size][own]))
    return out


def _texts(column: pa.Array):
    """The column's texts in blocks of about a quarter of a megabyte, null as empty."""
    texts = [t or "" for t in column.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for first, end in row_blocks(offsets, 1 << 18):
        yield first, texts[first:end]


@dataclass
class Model:
    """log_probability: a row for each bucket, a column for each language; prior: log shares of documents."""

    languages: list[str]
    log_probability: np.ndarray
    prior: np.ndarray


def fit(labelled: DataFrame, most: int = MOST_LABELLED, seed: int = 3) -> Model:
    """Fit on the rows of (doc_id, text, lang) whose lang isn't null, on a sample of about `most` rows, whole texts.
    Each document's counts are scaled to at most 2,000 n-grams, so that a few long ones don't outweigh the rest."""
    sample = bounded_sample(labelled.filter(F.col("lang").isNotNull()), F.col("doc_id"), most, seed).select("text", "lang").repartition(8)  # bounded, so few tasks and matrices

    def counted(batches):
        totals: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in _texts(batch.column("text")):
                found, own = grams(texts), np.array(langs[first : first + len(texts)], object)
                sizes = sum(np.bincount(rows, minlength=len(texts)) for _, rows in found)
                weight = np.minimum(1.0, 2000 / np.maximum(1, sizes))
                for lang in sorted(set(own)):
                    mine = own == lang
                    docs[lang] = docs.get(lang, 0) + int(mine.sum())
                    for ids, rows in found:
                        totals[lang] = totals.get(lang, 0) + np.bincount(ids, weights=weight[rows] * mine[rows], minlength=1 << BITS)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array(list(docs.values()), pa.int64()), pa.array([t.astype("<f4").tobytes() for t in totals.values()], pa.binary())], names=["lang", "docs", "counts"])

    docs: dict[str, int] = {}
    counts: dict[str, np.ndarray] = {}
    for row in sample.mapInArrow(counted, "lang string, docs long, counts binary").orderBy("lang", "counts").toLocalIterator():  # a row for each task and language
        docs[row["lang"]] = docs.get(row["lang"], 0) + row["docs"]
        counts[row["lang"]] = counts.get(row["lang"], 0) + np.frombuffer(row["counts"], "<f4").astype(np.float64)
    languages = sorted(docs)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    matrix = np.stack([counts[x] + 0.1 for x in languages], 1)
    n = np.array([docs[x] for x in languages], np.float64)
    return Model(languages, np.log(matrix / matrix.sum(0)).astype(np.float32), np.log(n / n.sum()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (probability of lang_pred, 0 to 1) added, from the whole text alone. A null text, one
    without letters, and any text under a model that has learned no language, is `und` with score 0. Columns of these
    names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, np.ascontiguousarray(model.log_probability.T), model.prior))
    kept = docs.drop("lang_pred", "score")

    def predicted(batches):
        languages, columns, prior = shared.value
        for batch in batches:
            names, scores = [], []
            for _, texts in _texts(batch.column("text")):
                found = grams(texts)
                known = np.bincount(found[0][1], minlength=len(texts)) > 0 if languages else np.zeros(len(texts), bool)
                logs = np.tile(prior, (len(texts), 1))
                for k, column in enumerate(columns):  # a product of the texts' sparse rows with one language's column
                    for ids, rows in found:
                        logs[:, k] += np.bincount(rows, weights=column[ids], minlength=len(texts))
                if not languages:
                    logs = np.zeros((len(texts), 1))
                best = logs.argmax(1)
                p = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                names += [languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
                scores.append(np.where(known, p, 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(predicted, StructType([*kept.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))
