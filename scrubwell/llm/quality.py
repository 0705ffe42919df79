r"""Operator 10: quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per
rule; a policy is a version and a mask of enforced bits, so verdicts, new policies and ablations are
bitwise operations on the ledger and never read a text again.

Words are ``[^\x20\x09-\x0D]+``. Null and empty texts have no words, fail ``few_words`` and are dropped.
Texts are handled one by one, so repeated rows get equal verdicts and empty tables an empty ledger;
further columns aren't read. Comparisons are on integers, so a value at a threshold always passes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.llm.common import map_rows, read_table

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    #: SQL over the measurements; true if a document fails.
    fails: str


RULES = (
    Rule(1, "few_words", "n_words < 50"),
    Rule(2, "repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(8, "repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule(16, "short_words", "word_chars < 2 * n_words"),
    Rule(32, "long_words", "word_chars > 25 * n_words"),
)
BASE = 1 | 2


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("v1", BASE | 4 | 8), Policy("v2", 63))}


def measure(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()
    n = len(words)
    blanks = sum(map(text.count, BLANKS))
    seen, lines, repeated = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            if line in seen:
                repeated += 1
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    covered = 0
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if count[w] > 1:
                covered += i + 3 - max(i, upto)
                upto = i + 3
    return n, len(text) - blanks, sum(map(text.count, SYMBOLS)), lines, repeated, covered


def ledger(df: DataFrame, *, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key``, the measurements, and ``fail_bits`` of all rules."""
    source = df.select(df[key].cast("long").alias("key"), df[text].cast("string").alias("text"))

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for k, t in it:
            yield k, *measure(t or "")

    schema = pa.schema([(x, pa.int64()) for x in ("key", *MEASURES)])
    found = map_rows(source, rows, "key long, " + ", ".join(f"{x} long" for x in MEASURES), schema)
    bits = sum((F.when(F.expr(r.fails), F.lit(r.bit)).otherwise(0) for r in rules), F.lit(0)).cast("long")
    return found.withColumn("fail_bits", bits).withColumnRenamed("key", key)


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policies(rows: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """The ledger with a column ``kept_<version>`` for each policy."""
    return rows.withColumns({f"kept_{p.version}": passes(p) for p in policies})


def ablation(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per enforced rule: documents that fail it, that fail it alone, and that are kept without it.

    One aggregation by failure pattern (2 to the number of rules at most), then bit arithmetic on those.
    """
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    named = [(r.bit, r.name) for r in rules if r.bit & policy.mask]
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(n).alias("rule")) for b, n in named])).alias("r")
    flat = patterns.select("bits", "n", each).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    return flat.groupBy("rule", "bit").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(hit & rest, F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        F.coalesce(F.sum(F.when(rest, F.col("n"))), F.lit(0)).alias("n_kept_without"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, full = POLICIES["base"], POLICIES["v1"]
    return ledger(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(base)).alias("base_failed"),
        (passes(base) & passes(full)).alias("kept"),
        "fail_bits",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the strictest policy drops, in all and alone."""
    return ablation(ledger(read_table(spark, sf_dir, "documents")), POLICIES["v2"])


_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
p AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 15) = 0 AS kept, fail_bits
FROM b"""

_RULES_SQL = " UNION ALL ".join(f"SELECT '{r.name}' AS rule, {r.bit} AS bit" for r in RULES)
_ABLATION_SQL = f"""
SELECT rule, bit::INT AS bit, count(*) FILTER ((fail_bits & bit) <> 0) AS n_failed,
       count(*) FILTER (fail_bits = bit) AS n_failed_alone, count(*) FILTER ((fail_bits & (63 - bit)) = 0) AS n_kept_without
FROM ({_SQL}), ({_RULES_SQL}) GROUP BY rule, bit"""

QUERIES = {"op10_quality": op10_quality, "quality_ablation": quality_ablation}
ORACLE_SQL = {"op10_quality": _SQL, "quality_ablation": _ABLATION_SQL}
