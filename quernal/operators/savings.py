"""The savings ledger: parse, summarise by overlapping periods, append, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts double, call string, results bigint, snippet_chars bigint, file_chars bigint"
BUCKETS = ("All time", "Last 7 days", "Today")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited JSON; lines that don't parse are skipped, numbers that are missing, negative or no integers are 0."""
    return parsed(spark.read.text(path))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (value) of a ledger, read as :func:`read` does."""
    loose = "ts string, call string, results string, snippet_chars string, file_chars string, _bad string"
    rows = lines.select(F.from_json("value", loose, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).where("r is not null and r._bad is null").select("r.*")
    whole = [F.when(F.col(c).rlike(r"^\d+$"), F.col(c).try_cast("bigint")).alias(c) for c in ("results", "snippet_chars", "file_chars")]
    return cleaned(rows.select(F.col("ts").try_cast("double").alias("ts"), "call", *whole))


def cleaned(rows: DataFrame) -> DataFrame:
    number = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("bigint").alias(c)
    return rows.select("ts", F.coalesce("call", F.lit("unknown")).alias("call"), number("results"), number("snippet_chars"), number("file_chars"))


def summary(ledger: DataFrame, now: float) -> DataFrame:
    """(bucket, calls, snippet_chars, file_chars, saved_chars); all three buckets are always there.

    A record counts in each period it falls in; without a time only in All time.  Days are UTC.
    """
    today = F.to_date(F.timestamp_seconds(F.lit(now)))
    day = F.to_date(F.timestamp_seconds("ts"))
    inside = {"All time": F.lit(True), "Last 7 days": F.coalesce(day >= F.date_sub(today, 7), F.lit(False)), "Today": F.coalesce(day == today, F.lit(False))}
    each = ledger.select("*", F.explode(F.filter(F.array(*[F.when(c, F.lit(b)) for b, c in inside.items()]), lambda b: b.isNotNull())).alias("bucket"))
    sums = each.groupBy("bucket").agg(F.count("*").alias("calls"), F.sum("snippet_chars").alias("snippet_chars"), F.sum("file_chars").alias("file_chars"), F.sum(F.greatest(F.col("file_chars") - F.col("snippet_chars"), F.lit(0))).alias("saved_chars"))
    wanted = ledger.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return wanted.join(sums, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "snippet_chars", "file_chars", "saved_chars")])


def calls(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("call").agg(F.count("*").alias("n"))


def record(found: DataFrame, sizes: DataFrame, call: str, ts: float) -> DataFrame:
    """found (file_path, content), sizes (file_path, size) -> the one ledger row of a call."""
    snippets = found.agg(F.count("*").alias("results"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("bigint").alias("snippet_chars"))
    files = found.select("file_path").distinct().join(sizes, "file_path").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("file_chars"))
    return snippets.crossJoin(files).select(F.lit(ts).alias("ts"), F.lit(call).alias("call"), "results", "snippet_chars", "file_chars")


def records(queries: DataFrame, found: DataFrame, sizes: DataFrame, call: str, ts: float) -> DataFrame:
    """queries (qid), found (qid, file_path, content), sizes (file_path, size) -> a ledger row for each query of a batch."""
    snippets = found.groupBy("qid").agg(F.count("*").alias("results"), F.sum(F.octet_length("content")).cast("bigint").alias("snippet_chars"))
    files = found.select("qid", "file_path").distinct().join(sizes, "file_path").groupBy("qid").agg(F.sum("size").cast("bigint").alias("file_chars"))
    rows = queries.select("qid").join(snippets, "qid", "left").join(files, "qid", "left")
    return rows.select(F.lit(ts).alias("ts"), F.lit(call).alias("call"), *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("results", "snippet_chars", "file_chars")])


def tokens_text(chars: int) -> str:
    tokens = chars // 4
    return f"~{tokens / 1e6:.1f}M" if tokens >= 1_000_000 else f"~{tokens / 1e3:.1f}k" if tokens >= 1000 else f"~{tokens}"


def report(rows: list, by_call: list = ()) -> str:
    """A line for each bucket, in alphabetical order, and one for each kind of call."""
    lines = []
    for row in sorted(rows, key=lambda r: r["bucket"]):
        percent = row["saved_chars"] * 100 // row["file_chars"] if row["file_chars"] else 0
        lines.append(f"{row['bucket']:<12} {row['calls']:>6} calls  {tokens_text(row['saved_chars']):>8} tokens saved ({percent}%)")
    lines += [f"{row['call']:<12} {row['n']:>6} calls" for row in sorted(by_call, key=lambda r: r["call"])]
    return "\n".join(lines)
