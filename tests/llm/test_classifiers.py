"""Batch scoring of both classifiers against plain sums, odd rows through the queries, and held-out labels."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from quernal.llm import kernel, langid, toxicity

SMALL = "/root/testdata/sf0.01"


def hash_of(word):
    return int(kernel.words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())])).hashes[0])


def mixed(x):
    return int(kernel.mix(np.array([x % 2**64], np.uint64))[0])


def toxic_slots(text):
    """The hashed words, pairs and pairs one apart of a text, by the words one by one."""
    text = "".join(" " if 33 <= ord(c) < 127 and not c.isalnum() else c for c in text or "")
    h = [hash_of(w) for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    pairs = [mixed(a * 3 + b + salt) for gap, salt in ((1, 101), (2, 202)) for a, b in zip(h, h[gap:])]
    return {x >> (64 - toxicity.HASH_BITS) for x in [*h, *pairs]}


def language_scores(model, text):
    """Sums over subwords of one text, and how many subwords there are."""
    clean = langid.letters_only(pa.array([text])).to_pylist()[0].encode()
    sums, n = np.zeros(len(model.languages)), 0
    for order in langid.ORDERS:
        for i in range(len(clean) - order + 1):
            gram = int.from_bytes(clean[i : i + order], "big")
            sums += model.scores[mixed(gram + (order << 40)) >> (64 - langid.BUCKET_BITS)]
            n += 1
    logits = (sums / max(n, 1) + model.bias) / model.temperature
    p = np.exp(logits - logits.max())
    return p / p.sum()


def odd_texts():
    rng = random.Random(8)
    words = ["You", "IDIOT", "idiot,", "dog-cat", "é", "漢字", "the", "w1", "--", "der", "Hund", "und"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(80)] + ["", " \n", "word " * 50_000 + "idiot", "idiot", "idiot"]


def test_toxicity_scores_are_plain_sums(spark):
    rng = random.Random(3)
    clean = lambda: " ".join(f"w{rng.randrange(60)}" for _ in range(20))
    model = toxicity.train([(clean(), 0) for _ in range(100)] + [(clean() + " idiot the idiot " + clean(), 1) for _ in range(60)])
    weights = dict(zip(model.index.tolist(), np.float32(model.weight).tolist()))
    texts = odd_texts()
    got = {r.row.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        want = 1 / (1 + math.exp(-(model.bias + sum(weights.get(slot, 0.0) for slot in toxic_slots(text)))))
        assert abs(got[i] - want) < 1e-5, text[:50]
    assert got[len(texts) - 1] == got[len(texts) - 2] > got[len(texts) - 5]


def test_language_scores_are_plain_sums(spark):
    model = langid.train([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"), ("le chat et le chien " * 5, "fr")] * 8)
    texts = odd_texts()[:40] + ["the dog", "der Hund", "x"]
    got = {r.row.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        if not re.search(r"[^\W\d_]", text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            want = language_scores(model, text)
            assert abs(got[i].score - want.max()) < 1e-6 and got[i].lang_pred == model.languages[int(want.argmax())], text


def test_queries_of_odd_tables(spark, tmp_path):
    rows = [(1, "the cat", "en"), (1, "the cat", "en"), (2, None, "de"), (None, "der hund", None), (3, "", None), (4, "x " * 200_000, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'a' as row", "1 as score", "2 as label", "true as held_out").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (1, 1), (9, 1), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = langid.query(spark, str(tmp_path))
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows)
    assert {r.lang_pred for r in got.where("doc_id in (2, 3)").collect()} == {"und"}
    scored = toxicity.query(spark, str(tmp_path))
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.collect())


def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic in (0, 1)").select("doc_id", "toxic")
    rows = toxicity.query(spark, SMALL).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    # some 300 rows are learned from here; with 12,000 the recall is 0.98
    assert len(clean) > 50 and sum(clean) <= 0.02 * len(clean) and sum(toxic) >= 0.5 * len(toxic)
