"""Tables as corpora: documents as files of one chunk, or as many chunks of a file per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The language of each extension.
EXTENSIONS = {".rs": "rust", ".py": "python", ".pyi": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".java": "java", ".go": "go", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".rb": "ruby", ".md": "markdown", ".markdown": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml"}
PLACES = ("src/", "tests/", "legacy/", "latest/", "types/", "pkg/")

#: File names that the documents of a source take in turn.
NAMES = ("main.rs", "a_test.rs", "__init__.py", "types.d.ts", "App.TSX", "x.tar.gz", ".rs", "Makefile", "notes.md", "win\\tests\\y.go", "conf.yml")


def detect_language(path):
    """Language by lower-cased extension, or null; a name that is only an extension has none."""
    names = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return names[F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))]


def spread(rows: DataFrame) -> DataFrame:
    """A scan of few partitions may be a single row group, which one task reads: then its rows are dealt out to all cores.

    A scan of more than two partitions a core, which any large table is, stays as it is and shuffles nothing.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() <= 2 * cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("file_path"), F.lit(0).alias("chunk_no"), "lang", F.col("text").alias("content"), "doc_id", "source")


def documents_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source one file, every document a chunk of it; the folder turns by the source's digits."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    place = F.element_at(F.array(*[F.lit(p) for p in PLACES]), (F.regexp_extract("source", "([0-9]*)$", 1).try_cast("int") % len(PLACES) + 1).cast("int"))
    return docs.select(F.concat(place, "source", F.lit(".d.ts")).alias("file_path"), F.col("doc_id").cast("int").alias("chunk_no"), "lang", F.col("text").alias("content"))


def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path): one for each document, of every kind of folder and name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))
    return docs.select(F.concat(pick(PLACES, F.floor(F.col("doc_id") / len(NAMES))), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), pick(NAMES, F.col("doc_id"))).alias("path"))
