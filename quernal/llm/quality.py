"""Quality rules: a ledger of rule bits and measurements, read by versioned policies.

Each rule is evaluated once per document; the ledger keeps the failed rules as bits of one long beside the measurements
they came from.  A policy is a named mask over those bits, so changing one means reading the ledger, not the texts, and
the effect of leaving a rule out of a policy is a bitwise aggregation over the (few) distinct bit patterns.  Everything
is DataFrame expressions: one pass over the texts and no shuffle.

A word is a run of characters other than ASCII white space.  Windows of eight words are compared by 64-bit hashes that
are built in three doubling steps (pairs, fours, eights), so a window costs three hash evaluations, not eight.

A stored ledger (:func:`store`) answers later policies without the texts (:func:`stored`) and ablations.

Defined cases: a null text counts as empty; a very long text is one row's work, linear but for the sort of its windows; columns
of docs may have any names; an empty text has no words, fails ``few_words`` and is not kept; rows are
judged one by one, so repeated rows get equal verdicts; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.llm.scratch import Scratch
from quernal.llm.text import once, packed, table, words_of

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_chars", "n_letters", "n_capitals", "n_stutters", "n_bullet_lines", "n_ellipsis_lines", "n_marks", "n_unspaced")

#: name -> condition under which a document fails, over the measurements; a rule's place here is its bit.
#: Append new rules, never reorder: stored ledgers keep their meaning.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "few_letters": "100 * n_letters < 60 * word_chars",
    "capitals": "100 * n_capitals > 60 * n_letters",
    "repeated_lines": "n_lines > 3 and 100 * n_dup_lines > 40 * n_lines",
    "bullets": "n_lines > 3 and 100 * n_bullet_lines > 90 * n_lines",
    "ellipses": "n_lines > 3 and 100 * n_ellipsis_lines > 30 * n_lines",
    "stutters": "100 * n_stutters > 20 * n_words",
    # combining marks are part of letters (Devanagari, Thai); scripts without spaces have long runs, not long words
    "few_letters_or_marks": "100 * (n_letters + n_marks) < 60 * word_chars",
    "long_spaced_words": "word_chars > 15 * n_words and 2 * n_unspaced < word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_words")
#: version -> the rules it applies.
_PROSE_1 = ("few_words", "repeated_words", "symbols", "short_words", "long_words", "few_letters", "capitals", "repeated_lines", "bullets", "ellipses", "stutters")
_PROSE_2 = ("few_words", "repeated_words", "symbols", "short_words", "long_spaced_words", "few_letters_or_marks", "capitals", "repeated_lines", "bullets", "ellipses", "stutters")
POLICIES: dict[str, tuple[str, ...]] = {"base-1": BASE, "prose-1": _PROSE_1, "prose-2": _PROSE_2}
POLICY = "prose-2"
#: Thai to Tibetan, Burmese, Khmer, kana and Han: scripts written without spaces between words.
UNSPACED = r"\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"


def mask_of(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _repeated_words(grams: Column) -> Column:
    """How many words lie in windows whose hash occurs more than once, from the hashes in order of position."""
    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def positions(s: Column) -> Column:
        later = F.slice(s, 2, F.size(s) - 1)  # one shorter: the last element meets null
        with_next = F.zip_with(s, later, lambda x, y: F.struct(x["h"].alias("h"), x["p"].alias("p"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("again")))
        before = F.concat(F.slice(F.transform(s, lambda x: F.struct(x["h"].alias("h"))), 1, 0), F.array(F.struct(F.lit(None).cast("long").alias("h"))), F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: F.struct(x["h"].alias("h"))))
        marked = F.zip_with(with_next, before, lambda x, y: F.when(x["again"] | F.coalesce(x["h"] == y["h"], F.lit(False)), x["p"]))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.size(p) - 1), lambda a, b: F.coalesce(F.least(F.lit(WINDOW), b - a), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    # one-element arrays bind a value that is used several times
    found = F.transform(F.array(ordered), positions)
    return F.element_at(F.transform(found, covered), 1)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs -> (row, measurements..., failed_bits); ``row`` packs every column of docs."""
    t = F.col("t")
    step = docs.select(packed(docs).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    step = step.select("row", "t", words_of(t).alias("words"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    step = step.select("row", "t", "lines", F.size("words").cast("long").alias("n_words"), F.array_join("words", "").alias("joined"), F.transform("words", lambda w: F.xxhash64(w)).alias("h1"))
    n, wide = F.col("n_words"), F.col("n_words") >= WINDOW
    none = F.array().cast("array<bigint>")

    def doubled(h: str, by: int) -> Column:
        shifted = F.slice(F.col(h), by + 1, F.greatest(F.size(h) - by, F.lit(0)))
        return F.when(wide, F.zip_with(h, shifted, lambda a, b: F.xxhash64(a, b))).otherwise(none)

    repeats = F.size(F.filter(F.zip_with("h1", F.slice("h1", 2, F.greatest(F.size("h1") - 1, F.lit(0))), lambda a, b: a == b), lambda same: same))
    step = step.withColumn("n_stutters", repeats.cast("long"))
    for h, to, by in (("h1", "h2", 1), ("h2", "h4", 2), ("h4", "h8", 4)):
        step = step.select(*[c for c in step.columns if c != h], doubled(h, by).alias(to))
    step = step.withColumn("h8", F.when(wide, F.slice("h8", 1, (n - WINDOW + 1).cast("int"))).otherwise(none))
    joined = F.col("joined")
    lines = F.col("lines")
    step = step.select(
        "row", "n_words",
        F.char_length(joined).cast("long").alias("word_chars"),
        (F.char_length(joined) - F.char_length(F.regexp_replace(joined, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h8")) == F.size("h8"), 0).otherwise(_repeated_words(F.col("h8"))).cast("long").alias("n_repeat_words"),
        F.char_length("t").cast("long").alias("n_chars"),
        (F.char_length(joined) - F.char_length(F.regexp_replace(joined, r"\p{L}+", ""))).cast("long").alias("n_letters"),
        (F.char_length(joined) - F.char_length(F.regexp_replace(joined, r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        "n_stutters",
        F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        *[F.when(F.octet_length(joined) == F.char_length(joined), 0).otherwise(F.char_length(joined) - F.char_length(F.regexp_replace(joined, pattern, ""))).cast("long").alias(c) for c, pattern in (("n_marks", r"\p{M}+"), ("n_unspaced", f"[{UNSPACED}]+"))],
    )
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0)).cast("long")
    return step.select("row", *MEASURES, once(bits).alias("failed_bits"))


def passes(policy: str = POLICY) -> Column:
    """Whether a ledger row fails no rule of the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def ablations(rows: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """ledger -> (policy, without_rule, n_docs, n_kept): what each policy keeps, whole (null) and with one rule left out.

    Documents are counted per bit pattern first, at most 2^rules rows, and only those meet the variants.
    """
    patterns = rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    variants = [(policy, rule, sum(BIT[name] for name in names if name != rule)) for policy, names in policies.items() for rule in (None, *names)]
    listed = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).cast("string").alias("without_rule"), F.lit(m).cast("long").alias("mask")) for p, r, m in variants])
    each = patterns.select("failed_bits", "n", F.inline(listed))
    kept = F.when(F.col("failed_bits").bitwiseAND(F.col("mask")) == 0, F.col("n")).otherwise(0)
    return each.groupBy("policy", "without_rule").agg(F.sum("n").alias("n_docs"), F.sum(kept).alias("n_kept"))


def store(rows: DataFrame, path: str) -> None:
    """Append ledger rows to the ledger in a folder, under the number of rules that were known when they were made."""
    rows.withColumn("rules", F.lit(len(RULES))).write.mode("append").partitionBy("rules").parquet(path)


def stored(spark: SparkSession, path: str, policy: str = POLICY) -> DataFrame:
    """The rows of a stored ledger with ``kept`` by a policy: no text is read.  Rows made before all of the policy's rules
    were known can't be judged by it: their ``kept`` is null."""
    known = F.col("rules") >= max(map(list(RULES).index, POLICIES[policy])) + 1
    rows = spark.read.parquet(path)
    return rows.withColumn("kept", F.when(known, passes(policy)))


def keep(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The documents that pass the policy, with their own columns."""
    return ledger(docs).where(passes(policy)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: measurements, failed bits and verdict of every document."""
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("failed_bits").bitwiseAND(F.lit(mask_of("base-1")).cast("long")) != 0
    return rows.select("row.doc_id", *MEASURES, "failed_bits", base.alias("base_failed"), passes().alias("kept"))


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy keeps of the documents, whole and with one rule left out, from a stored ledger."""
    path = f"{Scratch(spark).root}/ledger"
    store(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), path)
    return ablations(spark.read.parquet(path))


_BITS = " + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES.items())
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
grams AS (SELECT r, unnest(range(1, len(words) - {WINDOW} + 2)) AS p, words FROM w),
g AS (SELECT r, p, array_to_string(words[p:p + {WINDOW - 1}], ' ') AS gram FROM grams),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + {WINDOW})) AS q FROM twice) GROUP BY r),
m AS (
  SELECT r, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, length(t)::BIGINT AS n_chars,
    length(regexp_replace(t, '\P{{L}}', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(t, '\P{{Lu}}', '', 'g'))::BIGINT AS n_capitals,
    len([i for i in range(2, len(words) + 1) if words[i] = words[i - 1]])::BIGINT AS n_stutters,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines,
    length(regexp_replace(t, '\P{{M}}', '', 'g'))::BIGINT AS n_marks, length(regexp_replace(t, '[^{UNSPACED}]', '', 'g'))::BIGINT AS n_unspaced
  FROM w),
full_m AS (SELECT m.*, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN covered c USING (r)),
bits AS (SELECT *, ({_BITS})::BIGINT AS failed_bits FROM full_m)
SELECT doc_id, {", ".join(MEASURES)}, failed_bits, (failed_bits & {mask_of("base-1")}) <> 0 AS base_failed, (failed_bits & {mask_of(POLICY)}) = 0 AS kept FROM bits
"""

_VARIANTS = ", ".join(f"('{p}', {'NULL' if r is None else repr(r)}, {sum(BIT[name] for name in names if name != r)})" for p, names in POLICIES.items() for r in (None, *names))
ABLATION_ORACLE = f"""WITH q AS ({ORACLE}), v AS (SELECT * FROM (VALUES {_VARIANTS}) v(policy, without_rule, mask))
SELECT policy, without_rule, count(*)::BIGINT AS n_docs, sum(CASE WHEN failed_bits & mask = 0 THEN 1 ELSE 0 END)::BIGINT AS n_kept FROM q, v GROUP BY policy, without_rule"""
