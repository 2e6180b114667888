"""What ranking reads off queries, chunks and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernal.functions.tokens import path_stem, split_identifier

# The query patterns, keywords, stopwords and factors that results depend on.
SYMBOL_QUERY = r"^(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9]*)$"
EMBEDDED_SYMBOL = r"\b(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)\b"
DEFINITION_KEYWORDS = ("class", "module", "defmodule", "def", "interface", "struct", "enum", "trait", "func", "function", "fn")
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "has", "have", "how", "if", "in", "is", "it", "not", "of", "on", "or", "the", "to", "was", "with")
ALPHA_SYMBOL, ALPHA_PROSE = 0.3, 0.5
TEST_PATHS, OLD_PATHS = ("test/", "tests/", "spec/"), ("compat", "legacy", "examples")


def trimmed(text: Column) -> Column:
    """All white space off both ends (``trim`` takes only spaces)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_symbol_query(query: Column) -> Column:
    return trimmed(query).rlike(SYMBOL_QUERY)


def resolve_alpha(query: Column, alpha: Column | None = None) -> Column:
    auto = F.when(is_symbol_query(query), ALPHA_SYMBOL).otherwise(ALPHA_PROSE)
    return auto if alpha is None else F.coalesce(alpha, auto)


def query_symbols(query: Column) -> Column:
    """The last part of a symbol query, or the camel-case words in a prose query."""
    last = F.element_at(F.split(trimmed(query), r"::|\\|->|\."), -1)
    return F.when(is_symbol_query(query), F.array(last)).otherwise(F.array_distinct(F.regexp_extract_all(query, F.lit(f"({EMBEDDED_SYMBOL})"), 1)))


def path_keywords(query: Column) -> Column:
    words = F.split(F.lower(query), r"\s+")
    return F.filter(words, lambda w: (F.octet_length(w) > 2) & ~w.isin(*STOPWORDS))


def path_hits(keywords: Column, path: Column) -> Column:
    """How many keywords begin, in their first three characters, some part of the path's stem."""
    parts = split_identifier(F.lower(path_stem(path)))
    return F.size(F.filter(keywords, lambda w: F.exists(parts, lambda p: F.startswith(p, F.left(w, F.lit(3))))))


def path_penalty(path: Column) -> Column:
    p = F.regexp_replace(path, r"\\", "/")
    has = lambda names: F.greatest(*[F.contains(p, F.lit(n)) for n in names])
    test = F.when(has(TEST_PATHS) | F.endswith(p, F.lit("_test.rs")), 0.3).otherwise(1.0)
    init = F.when(F.regexp_extract(p, "([^/]*)$", 1) == "__init__.py", 0.5).otherwise(1.0)
    old = F.when(has(OLD_PATHS), 0.3).otherwise(1.0)
    return test * init * old * F.when(F.endswith(p, F.lit(".d.ts")), 0.7).otherwise(1.0)


def is_trivial_doc(content: Column) -> Column:
    """Every line that isn't blank is a comment or heading marker, and there is one."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"\S"))
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"^\s*(//|/\*|\*|#|<!--)"))


def sql_penalty(path: str) -> str:
    p = f"replace({path}, '\\', '/')"
    has = lambda names: " OR ".join(f"contains({p}, '{n}')" for n in names)
    return f"""((CASE WHEN {has(TEST_PATHS)} OR ends_with({p}, '_test.rs') THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END)
      * (CASE WHEN regexp_extract({p}, '([^/]*)$', 1) = '__init__.py' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)
      * (CASE WHEN {has(OLD_PATHS)} THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN ends_with({p}, '.d.ts') THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END))"""
