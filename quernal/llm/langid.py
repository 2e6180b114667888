"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is the average of the embeddings of its subwords: byte n-grams of 2 to 4 of the case-folded text whose runs of
anything but letters are one separator, so word beginnings and ends show.  Since the classifier is linear, embedding
times weights is one small table of scores per subword, and prediction is an average of table rows; the table has
2**BUCKET_BITS rows, whatever the corpus, and is broadcast.  A temperature and, for each language, the score below which
a prediction is rejected are fitted on labelled rows kept from the training.

Training reads at most TRAIN_ROWS labelled rows (documented bound); prediction reads every whole text.

Defined cases: text null or without any letter: ``und``, score 0; no labelled rows to learn from: ``und`` for all;
rejected predictions keep their language and say so in ``rejected``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.llm import kernel
from quernal.llm.labels import sample, splits
from quernal.llm.text import held_out, packed, table

TRAIN_ROWS, TRAIN_CHARS = 4000, 20_000
BUCKET_BITS, DIM, EPOCHS, RATE = 16, 16, 8, 0.5
ORDERS = (2, 3, 4)
#: Share of right predictions that rejection may cost, by language.
REJECT = 0.005


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # (2**BUCKET_BITS, languages)
    bias: np.ndarray
    temperature: float
    least: np.ndarray  # score below which a language's prediction is rejected


def letters_only(texts: pa.Array) -> pa.Array:
    """Lower case, each run of other than letters one space, and a space at either end."""
    low = pc.utf8_lower(texts)
    return pc.binary_join_element_wise("", pc.replace_substring_regex(low, pattern=r"[^\p{L}]+", replacement=" "), "", " ")


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: buckets of all n-grams in the block, and where each text's begin (one more at the end)."""
    n = len(data)
    wide = data.astype(np.uint64)
    gram = wide.copy()
    for order in range(2, max(ORDERS) + 1):
        if n < order:
            return
        gram = (gram[: n - order + 1] << np.uint64(8)) | wide[order - 1 :]
        if order in ORDERS:
            buckets = (kernel.mix(gram + (np.uint64(order) << np.uint64(40))) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            sizes = np.maximum(np.diff(offsets) - order + 1, 0)
            if len(sizes) > 1:  # n-grams across two texts belong to neither
                inside = np.ones(len(buckets), bool)
                for back in range(1, order):
                    edge = offsets[1:-1] - back
                    inside[edge[(edge >= 0) & (edge < len(buckets))]] = False
                buckets = buckets[inside]
            yield buckets, np.concatenate([[0], np.cumsum(sizes)])


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, share of each) for each text."""
    out = []
    cleaned = letters_only(pa.array(texts, pa.string()))
    for text in cleaned:
        raw = np.frombuffer(text.as_py().encode(), np.uint8)
        found = [b for b, _ in subwords(raw, np.array([0, len(raw)]))]
        buckets, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        out.append((buckets, counts / max(1, counts.sum())))
    return out


def train(rows: list[tuple[str, str]]) -> Model:
    """Embeddings and weights by stochastic gradient descent on (text, language) rows, then calibration."""
    languages = sorted({label for _, label in rows})
    known = np.array([languages.index(label) for _, label in rows], np.int64)
    features = _features([text for text, _ in rows])
    rng = np.random.default_rng(3)
    embedding = rng.normal(0, 1 / DIM, (1 << BUCKET_BITS, DIM))
    weights, bias = rng.normal(0, 1 / DIM, (DIM, len(languages))), np.zeros(len(languages))
    fit, tune = splits(len(rows))
    steps, step = max(1, EPOCHS * len(fit)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            buckets, share = features[i]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(buckets):
                continue
            hidden = share @ embedding[buckets]
            logit = hidden @ weights + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[known[i]] -= 1
            back = weights @ p
            weights -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            embedding[buckets] -= rate * len(buckets) ** 0.5 * np.outer(share, back)
    scores = embedding @ weights
    tune = tune if len(tune) else fit
    logits = np.array([share @ scores[buckets] + bias for buckets, share in (features[i] for i in tune)]).reshape(-1, len(languages))
    temperature = min((t for t in np.geomspace(0.02, 20, 60)), key=lambda t: -_log_softmax(logits / t)[np.arange(len(tune)), known[tune]].sum())
    best = np.exp(_log_softmax(logits / temperature))
    right = best.argmax(1) == known[tune]
    least = np.array([np.quantile(best[right & (known[tune] == k)].max(1), REJECT) if (right & (known[tune] == k)).any() else 0.0 for k in range(len(languages))])
    return Model(languages, scores.astype(np.float32), bias, float(temperature), least)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        columns = None if model is None else [np.ascontiguousarray(model.scores[:, k]) for k in range(len(model.languages))]
        for batch in batches:
            whole = batch.column("text")
            row = 0
            while row < len(whole):  # slices of bounded size, so that cleaned copies of a batch stay small
                stop = next(iter(kernel.blocks(whole.slice(row))))[1] + row
                raw = whole.slice(row, stop - row)
                languages, scores, rejected = ["und"] * len(raw), np.zeros(len(raw)), np.zeros(len(raw), bool)
                if model is not None:
                    texts = letters_only(raw.fill_null(""))
                    _, _, data, offsets = next(iter(kernel.blocks(texts, 1 << 62)))
                    sums, total = np.zeros((len(raw), len(columns))), np.zeros(len(raw))
                    for buckets, first in subwords(data, offsets):
                        for k, column in enumerate(columns):
                            sums[:, k] += kernel.fold(column[buckets].astype(np.float64), first, np.add)
                        total += np.diff(first)
                    p = np.exp(_log_softmax((sums / np.maximum(total, 1)[:, None] + model.bias) / model.temperature))
                    best = p.argmax(1)
                    lettered = np.array(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(texts)), 0))
                    languages = [model.languages[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
                    scores = np.where(lettered, p.max(1), 0.0)
                    rejected = lettered & (scores < model.least[best])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(row, stop - row), pa.array(languages, pa.string()), pa.array(scores), pa.array(rejected)], names=["row", "lang_pred", "score", "rejected"])
                row = stop

    return run


def fit(docs: DataFrame) -> Model | None:
    """A model from labelled rows of docs (doc_id, text, lang); None if there are none."""
    rows = sample(docs, docs.select("doc_id", F.col("lang").alias("label")), TRAIN_ROWS, TRAIN_CHARS)
    return train(rows) if rows else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with a text -> (row, lang_pred, score, rejected); ``row`` packs every column of docs but ``text`` itself."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(packed(docs.drop("text")).alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_predict(shared), f"row {kind}, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = identify(docs.select("doc_id", "text"), fit(docs))
    return done.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
