"""Identifier-aware tokens as column expressions.

``sql_*`` give the same expression in DuckDB's SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an identifier is, and where camel case has a boundary.
IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]*"
_LOWER_UPPER, _UPPER_WORD = "([a-z])([A-Z])", "([A-Z])([A-Z][a-z])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def identifiers(text: Column | str) -> Column:
    """All identifiers of a text in order, duplicates kept."""
    return F.regexp_extract_all(_col(text), F.lit(f"({IDENTIFIER})"), 1)


def split_identifier(token: Column) -> Column:
    """[lower, parts...] for a token of two or more snake or camel parts, else [lower]; snake wins over camel."""
    spaced = F.regexp_replace(F.regexp_replace(token, _LOWER_UPPER, "$1 $2"), _UPPER_WORD, "$1 $2")
    camel = F.split(F.lower(spaced), " ")
    snake = F.filter(F.split(F.lower(token), "_"), lambda part: part != "")
    parts = F.when(F.contains(token, F.lit("_")), snake).otherwise(camel)
    whole = F.array(F.lower(token))
    split = F.transform(F.array(parts), lambda p: F.when(F.size(p) >= 2, F.concat(whole, p)).otherwise(whole))[0]
    # most tokens have no boundary at all: one look spares them the rest
    return F.when(token.rlike(f"_|{_LOWER_UPPER}|{_UPPER_WORD}"), split).otherwise(whole)


def tokenize(text: Column | str) -> Column:
    return F.flatten(F.transform(identifiers(text), split_identifier))


def counted(values: Column, name: str, n: str) -> Column:
    """array<T> -> array<struct<name: T, n: bigint>>: each distinct value and how often it is there, in the row.

    The values are sorted, so equal ones are neighbours; what is counted is how far the ends of their runs lie apart.
    """

    def ends(s: Column) -> Column:
        last = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(b.isNull() | (a != b), a))
        return F.filter(F.transform(last, lambda t, i: F.struct(t.alias("t"), (i + 1).alias("e"))), lambda x: x["t"].isNotNull())

    def counts(e: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(e, lambda x: x["e"]))
        both = F.zip_with(e, before, lambda x, b: F.when(x.isNotNull(), F.struct(x["t"].alias(name), (x["e"] - b).cast("bigint").alias(n))))
        return F.filter(both, lambda x: x.isNotNull())

    # one-element arrays bind a value that is used several times
    return F.transform(F.transform(F.array(F.sort_array(values)), ends), counts)[0]


def path_stem(path: Column | str) -> Column:
    """File name without its last extension; a dot file is its own stem."""
    return F.regexp_extract(_col(path), r"([^/]+?)(\.[^./]*)?$", 1)


def enriched_tokens(content: Column | str, path: Column | str) -> Column:
    """The tokens of what the lexical index reads: the content, followed twice by the file's stem."""
    stem = tokenize(path_stem(path))
    return F.concat(tokenize(content), stem, stem)


def sql_split_identifier(t: str) -> str:
    camel = f"string_split(lower(regexp_replace(regexp_replace({t}, '{_LOWER_UPPER}', '\\1 \\2', 'g'), '{_UPPER_WORD}', '\\1 \\2', 'g')), ' ')"
    snake = f"[p for p in string_split(lower({t}), '_') if p <> '']"
    parts = f"(CASE WHEN contains({t}, '_') THEN {snake} ELSE {camel} END)"
    return f"(CASE WHEN len({parts}) >= 2 THEN [lower({t})] || {parts} ELSE [lower({t})] END)"


def sql_tokenize(text: str) -> str:
    return f"flatten([{sql_split_identifier('t')} for t in regexp_extract_all({text}, '({IDENTIFIER})', 1)])"


def sql_stem(path: str) -> str:
    return f"regexp_extract({path}, '([^/]+?)(\\.[^./]*)?$', 1)"


def sql_enriched(content: str, path: str) -> str:
    return f"({content} || ' ' || {sql_stem(path)} || ' ' || {sql_stem(path)})"
