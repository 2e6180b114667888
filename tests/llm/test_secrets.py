"""Spans against plain regular expressions, and a ledger that is kept over several runs."""

import hashlib
import random
import re

import pytest

from quernal.llm import secrets

#: The base kinds as they are defined: (kind, pattern, least length, group that has it).
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
)


def brute(text):
    found = [(m.start(), at, f"{kind}:{m.start()}:{m.end()}") for at, (kind, pattern, least, group) in enumerate(BASE) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return ",".join(x[2] for x in sorted(found))


def odd_texts():
    rng = random.Random(5)
    pieces = ["AKIA", "AKIAAKIA", "A1" * 9, "0f" * 12, "ab" * 11 + "c", "é", " ", "\n", "password", "TOKEN", "api_key", "apikey", '"', "'", "=", ":", " = ", "hunter22", "a/b+c=", "g", "\x01", "\x02", "secret=token:", "漢", "deadbeef"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(600)]


def test_against_plain_patterns(spark):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = [*odd_texts(), *real, None, "", "x" * 1_000_000 + " token=abcdefgh " + "0f" * 20]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.row.doc_id: r.base for r in secrets.secrets(rows).select("row", "base").collect()}
    assert got == {i: brute(text) for i, text in enumerate(texts)}


def test_query_and_clashing_names(spark, tmp_path):
    rows = [(1, "token=abcdefgh"), (None, "token=abcdefgh"), (1, None), (2, "plain")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as blob", "2 as row", "3 as spans", "4 as place").write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    sha = lambda text: hashlib.sha256(brute(text).encode()).hexdigest()
    assert sorted((r.doc_id or 0, r.n_assign, r.base_sha256) for r in got.collect()) == sorted((i or 0, int("token" in (t or "")), sha(t)) for i, t in rows)
    assert secrets.secrets(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() == 4


@pytest.mark.parametrize("broadcast", [True, False])
def test_ledger_over_runs(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(secrets, "BROADCAST_BLOBS", -1)
    schema = "path string, version int, text string"
    first = spark.createDataFrame([("a", 1, "token=abcdefgh"), ("b", 1, "plain"), ("c", 1, "token=abcdefgh")], schema)
    second = first.unionByName(spark.createDataFrame([("a", 2, "plain"), ("b", 2, "secret: zyxwvuts"), ("d", 1, None)], schema))
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.update(first)
    assert ledger.seen().count() == 2
    scanned = []
    real = secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda blobs: scanned.append(blobs.count()) or real(blobs))
    ledger.update(second)
    assert scanned == [2] and ledger.seen().count() == 4
    ledger.update(second)
    assert scanned == [2, 0] and ledger.seen().count() == 4
    spans = lambda version: {(r.row.path, r.row.version): r.spans for r in ledger.of(second, version).collect()}
    fresh = {(r.row.path, r.row.version): r.spans for r in secrets.secrets(second).collect()}
    assert spans(secrets.RULE_VERSION) == fresh and fresh["a", 1] == fresh["c", 1] == "assign:0:14" and fresh["a", 2] == "" and fresh["b", 2] == "assign:0:16"
    # other rules: every blob is scanned again under their version, and the old findings stay
    monkeypatch.setattr(secrets, "RULES", secrets.RULES | {"plain": ("plain", "0")})
    ledger.update(second, "secrets-2")
    assert scanned[-1] == 4 and ledger.seen().count() == 8
    assert spans("secrets-2")["a", 2] == "plain:0:5" and spans(secrets.RULE_VERSION) == fresh
