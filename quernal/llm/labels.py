"""Rows to learn from, bounded and the same on every run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernal.llm.text import held_out


def sample(docs: DataFrame, labelled: DataFrame, bound: int, max_chars: int) -> list[tuple[str, object]]:
    """docs (doc_id, text), labelled (doc_id, label) -> (text, label) of at most about ``bound`` rows to learn from.

    They are the labelled rows whose hashed doc_id comes first, chosen by id alone, so that no text is shuffled or sent
    but theirs.  Rows are whole texts; texts of over ``max_chars`` characters are no training rows, which bounds what
    the driver gets to ``bound * max_chars``.  (They are scored like any other.)  Held-out and null ids, null labels and
    null texts are left out.
    """
    usable = labelled.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = usable.select(F.xxhash64("doc_id", F.lit(11)).alias("order"), F.col("doc_id").alias("picked"), "label").orderBy("order", "picked", "label").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("picked")).where(F.char_length("text") <= max_chars)
    found = rows.select("order", "text", "label").toArrow().to_pylist()
    return [(row["text"], row["label"]) for row in sorted(found, key=lambda r: (r["order"], r["text"], str(r["label"])))]


def splits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices to fit on and indices to calibrate on, 3 : 1, at random but fixed."""
    order = np.random.default_rng(5).permutation(n)
    return order[n // 4 :], order[: n // 4]
