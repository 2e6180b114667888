"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its content (SHA-256).  A ledger remembers which blobs were scanned under which
rule version; a run scans only blobs it has not seen under this version, each once however many paths hold it, and the
findings, kept per blob, join back to all paths.  Copies are folded by a partially aggregated group-by before the texts
are shuffled, so a group of copies costs one text a task.

Spans are found natively: matches are fenced with marks, the text is split at the marks, and running sums of piece
lengths give offsets in code points.  Marks that occur in the text itself are first replaced by another control
character, which no pattern reads and which keeps every offset.

Defined cases: a null text is the empty text and has no findings; rows that repeat a blob get equal findings; a path
is any row, so null or repeated ids do no harm; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernal.llm.scratch import Scratch, exists
from quernal.llm.text import packed, table

_L, _R = "\x01", "\x02"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: kind -> (pattern, condition a match m must meet), in the order kinds are listed in; the first three are the base.
#: A run of one class of characters may have its least length in the pattern: a shorter run has no longer one in it.
RULES: dict[str, tuple[str, str]] = {
    "assign": (rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", "long value"),
    "access": ("AKIA[A-Z0-9]{16,}", "20"),
    "hex": ("[0-9a-f]{24,}", "24"),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", "0"),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "32"),
    "forge": ("gh[pousr]_[A-Za-z0-9]+", "40"),
}
BASE = ("assign", "access", "hex")
RULE_VERSION = "secrets-1"
#: Unseen blobs whose digests (64 characters each) are broadcast at most; beyond it they are joined by shuffling.
BROADCAST_BLOBS = 100_000
_VALUE = rf"""^(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _meets(match: Column, rule: str) -> Column:
    if rule == "long value":
        return F.char_length(F.regexp_extract(match, _VALUE, 1)) >= 6
    return F.char_length(match) >= int(rule)


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at its matches: pieces at odd places (from 0) are the matches."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{_L}$1{_R}"), f"[{_L}{_R}]")


def _measured(pieces: Column, rule: str) -> Column:
    return F.transform(pieces, lambda p, i: F.struct(F.char_length(p).alias("n"), ((i % 2 == 1) & _meets(p, rule)).alias("good")))


def scan(blobs: DataFrame) -> DataFrame:
    """blobs (blob, text) -> (blob, kind, place, start, end): all spans, in code points, end exclusive.

    A window over the pieces of one text; a text without any match gives no pieces at all.
    """
    text = F.translate("text", _L + _R, "\x03\x03")
    found = []
    for place, (kind, (pattern, rule)) in enumerate(RULES.items()):
        # pieces are made only where something matches; a null here costs no row
        pieces = F.when(text.rlike(pattern), _pieces(text, pattern))
        found.append(F.struct(F.lit(kind).alias("kind"), F.lit(place).alias("place"), _measured(pieces, rule).alias("pieces")))
    rows = blobs.select("blob", F.inline(F.array(*found))).select("blob", "kind", "place", F.col("pieces"))
    rows = rows.select("blob", "kind", "place", F.posexplode_outer("pieces").alias("i", "piece")).where("piece is not null")
    upto = Window.partitionBy("blob", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("blob", "kind", "place", F.sum("piece.n").over(upto).alias("end"), F.col("piece.n").alias("n"), F.col("piece.good").alias("good"))
    return rows.where("good").select("blob", "kind", "place", (F.col("end") - F.col("n")).alias("start"), "end")


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def findings(paths: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """paths with a text -> (spans of unseen blobs by :func:`scan`, ledger rows (blob, rule_version) they add).

    ``ledger`` has the (blob, rule_version) pairs scanned before; their spans are in the store the caller keeps.
    """
    blobs = paths.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    fold = lambda rows: rows.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        unseen = fold(blobs)
    else:
        seen = ledger.where(F.col("rule_version") == version).select(F.col("blob").alias("seen"))
        new = Scratch(paths.sparkSession).table(blobs.select("blob").distinct().join(seen, F.col("blob") == F.col("seen"), "left_anti"), "new").withColumnRenamed("blob", "new_blob")
        if new.count() <= BROADCAST_BLOBS:  # little is new: the texts seen before aren't shuffled
            unseen = fold(blobs.join(F.broadcast(new), F.col("blob") == F.col("new_blob"), "left_semi"))
        else:
            unseen = fold(blobs).join(new, F.col("blob") == F.col("new_blob"), "left_semi")
    return scan(unseen), unseen.select("blob", F.lit(version).alias("rule_version"))


class Ledger:
    """A ledger kept in a folder that all executors share: tables ``seen`` (blob, rule_version) and ``spans`` (as of
    :func:`scan`, with rule_version), both only ever appended to.

    Spans are written before the blobs they are of count as seen: a run that is lost in between is made again, and the
    spans it left are read once (they are distinct by blob, version, kind and place in the text).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        there = exists(self.spark, f"{self.folder}/{name}/_SUCCESS")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        return self._read("seen", "blob string, rule_version string")

    def spans(self, version: str = RULE_VERSION) -> DataFrame:
        rows = self._read("spans", "blob string, kind string, place int, start long, `end` long, rule_version string")
        return rows.where(F.col("rule_version") == version).drop("rule_version").distinct()

    def update(self, versions: DataFrame, version: str = RULE_VERSION) -> None:
        """versions with a text, of any paths and times: scan the blobs not yet seen under this rule version."""
        spans, added = findings(versions, self.seen(), version)
        scratch = Scratch(self.spark)
        added = scratch.table(added, "added")  # what is new is decided once, before anything is appended
        spans.select("blob", "kind", F.col("place").cast("int").alias("place"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(version).alias("rule_version")).write.mode("append").parquet(f"{self.folder}/spans")
        added.write.mode("append").parquet(f"{self.folder}/seen")
        scratch.drop("added")

    def of(self, paths: DataFrame, version: str = RULE_VERSION) -> DataFrame:
        """paths with a text, all seen -> as :func:`secrets`, from the ledger alone."""
        return _joined(paths, self.spans(version))


def _at(place: int):
    return lambda span: span["place"] == place


def by_blob(spans: DataFrame) -> DataFrame:
    """spans -> one row per blob with findings: counts of the base kinds, and the spans listed by start, then kind."""
    rows = spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "place", "kind", "end"))).alias("found"))
    listed = lambda f: F.array_join(F.transform(f, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["place"] < len(BASE))
    counts = [F.size(F.filter("found", _at(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    return rows.select("blob", *counts, listed(base).alias("base"), listed(F.col("found")).alias("spans"))


def secrets(paths: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """paths with a text -> (row, blob, n_assign, n_access, n_hex, base, spans), ``row`` packing every column of paths.

    ``known`` has the spans (as of :func:`scan`) of the blobs that ``ledger`` says were scanned before.
    """
    spans, _ = findings(paths, ledger)
    return _joined(paths, spans if known is None else spans.unionByName(known))


def _joined(paths: DataFrame, spans: DataFrame) -> DataFrame:
    found = Scratch(paths.sparkSession).table(by_blob(spans), "found").withColumnRenamed("blob", "found_blob")
    rows = paths.select(packed(paths).alias("row"), blob_of(F.col("text")).alias("blob"))
    out = rows.join(found, F.col("blob") == F.col("found_blob"), "left")
    counts = [F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return out.select("row", "blob", *counts, F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: findings of every document, from an empty ledger."""
    done = secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [f"n_{kind}" for kind in BASE]
    return done.select("row.doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def _oracle() -> str:
    parts = []
    for place, (kind, (pattern, rule)) in enumerate(RULES.items()):
        quoted = pattern.replace("'", "''")
        value = _VALUE.replace("'", "''")
        good = f"length(regexp_extract(m, '{value}', 1)) >= 6" if rule == "long value" else f"length(m) >= {rule}"
        parts.append(f"""SELECT r, '{kind}' AS kind, {place} AS place, pieces[i] AS m, list_sum([length(p) for p in pieces[1:i]])::BIGINT AS stop, {good} AS good
          FROM (SELECT r, pieces, unnest(range(2, len(pieces) + 1, 2)) AS i FROM (
            SELECT r, string_split(regexp_replace(t, '({quoted})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS pieces FROM t))""")
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (SELECT r, kind, place, stop - length(m) AS start, stop, kind || ':' || (stop - length(m)) || ':' || stop AS span FROM m WHERE good),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(span, ',' ORDER BY start, place) FILTER (place < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, place) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (r)
"""


ORACLE = _oracle()
