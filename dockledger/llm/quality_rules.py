"""Quality rules as a ledger of failure bits, with policies applied afterwards.

Every rule is evaluated once for each document. The ledger holds the measurements and
one number whose bit i is set if rule i fails. A policy is a version name and the
mask of rules that reject; changing a policy or asking what a rule alone rejects needs
the ledger only, never the texts: ``failed & mask`` decides, ``failed & mask = bit``
finds documents that one rule alone rejects, and bit counts are sums.

Built-in expressions only: one projection over the documents, no shuffle. A repeated
3-word window is found by sorting the window hashes of a document with their places.

Defined results: a null or empty text has no words, measures zero and fails
``few_words``; repeated rows give repeated ledger rows; an empty table gives none; input
columns other than the id and the text do not matter, whatever their names; a text of
any length is measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockledger.llm.common import WHITE, words


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # an SQL condition over the measurements


# The order fixes the bits: append new rules, never reorder.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("few_letters", "100 * n_letters < 60 * word_chars"),
    Rule("shouting", "100 * n_upper > 60 * n_letters"),
    Rule("exclaiming", "100 * n_exclaims > 50 * n_words"),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": tuple(r.name for r in RULES),
    "v2-lenient": (*BASE, "symbols", "exclaiming"),
}


def mask(names: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    at = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << at[n] for n in set(names))


def _repeat_words() -> Column:
    """Words that lie in a window of three words found twice or more. ``_sorted`` has
    (hash, place) of each window in order; ``_starts`` the places of repeated ones."""
    i = "(x, i) -> x.h = get(_sorted, i - 1).h OR x.h = get(_sorted, i + 1).h"
    return F.expr(f"sort_array(transform(filter(_sorted, {i}), x -> x.p))")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the measurements that the rules use."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    split = base.select(
        "doc_id",
        words(F.col("_text")).alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: F.regexp_replace(line, WHITE, "") != "").alias("_lines"),
        F.length(text).alias("_chars"),
        text.alias("_text"),
    )
    counted = split.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_text", r"[^\p{L}\p{M}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_text", r"[^!]+", "")).cast("long").alias("n_exclaims"),
        F.expr(
            "sort_array(transform(IF(size(_words) < 3, array(), sequence(0, size(_words) - 3)), "
            "i -> named_struct('h', xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)), 'p', i)))"
        ).alias("_sorted"),
    )
    starts = counted.withColumn("_starts", _repeat_words()).drop("_sorted")
    covered = F.expr("aggregate(_starts, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p)).n")
    # The row number keeps a later filter on the verdict above this projection. Pushed
    # below it, the filter would sort the windows again for each window.
    covered = F.when(F.monotonically_increasing_id() >= 0, covered)
    return starts.withColumn("n_repeat_words", covered).drop("_starts")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and the failure bits."""
    bits = " + ".join(f"IF({r.fails}, {1 << i}L, 0L)" for i, r in enumerate(RULES))
    return measure(docs, id_col, text_col).withColumn("failed", F.expr(bits))


def rejects(policy: str, col: str = "failed") -> Column:
    """Whether a policy rejects a ledger row."""
    return F.col(col).bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    return rows.withColumn("base_failed", rejects("base")).withColumn("kept", ~(rejects("base") | rejects(policy))).withColumn("policy", F.lit(policy))


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """One row per rule of a policy: how many documents fail it, how many no other rule
    rejects, and how many the policy would keep without it. One pass over the ledger;
    each task sends one row of sums."""
    m = mask(POLICIES[policy])
    names = [r.name for r in RULES if m & mask((r.name,))]
    hit = F.col("failed").bitwiseAND(F.lit(m))
    sums = rows.agg(
        F.count("*").alias("documents"),
        F.count(F.when(hit == 0, 1)).alias("kept"),
        F.bit_or(hit).alias("seen"),
        *[F.count(F.when(hit.bitwiseAND(F.lit(mask((n,)))) != 0, 1)).alias(f"f_{n}") for n in names],
        *[F.count(F.when(hit == mask((n,)), 1)).alias(f"o_{n}") for n in names],
    )
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("failed"), F.col(f"o_{n}").alias("only")) for n in names])).alias("r")
    return sums.select("documents", "kept", "seen", each).select(
        "r.rule", "r.failed", "r.only", (F.col("kept") + F.col("r.only")).alias("kept_without"), "kept", "documents"
    )


def keep_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of documents that a policy keeps, as they are."""
    named = docs.select(F.struct("*").alias("_row"), F.col("text"))
    judged = apply_policy(ledger(named, id_col="_row"), policy)
    return judged.filter("kept").select("doc_id.*")


# The same verdicts in DuckDB's SQL.
SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
wins AS (
  SELECT rid, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3) t
),
rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM wins) x WHERE c >= 2) y
  GROUP BY rid
),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[^\p{L}\p{M}]+', '', 'g')) AS BIGINT) AS n_letters,
         CAST(length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_exclaims,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN rep USING (rid)
),
l AS (SELECT *, CAST(@BITS AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = 0 AS kept, failed
FROM l
""".replace("@BITS", " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES)))
