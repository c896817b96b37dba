"""Quality rules with risk-controlled thresholds.

Every document is measured over its whole text, and each rule turns two counts into one number,
per thousand, that is high for poor text. Where to cut is learned from labelled documents:

* A holdout is the labelled documents that pass the base rules; a stratum is a value of one
  column (the language). For each stratum and rule the cutoffs of a fixed grid are tested from
  the most lenient to the strictest. A cutoff passes while the exact binomial tail
  ``P(Bin(n, risk) <= k)`` (``k`` of the ``n`` clean documents would be rejected), which is the
  exact (Clopper-Pearson) upper bound staying under ``risk``, is at most the level of the test.
* Multiple testing: testing in a fixed order and stopping at the first failure needs no share
  for each cutoff; the level ``error`` is divided by rules times strata (Bonferroni). So with
  probability ``1 - error`` no rule falsely rejects more than ``risk`` of the clean documents of
  any stratum, and all rules together at most ``risk`` times the number of rules. The guarantee
  takes labelled documents as exchangeable with the others of their stratum.
* Of the cutoffs that pass, the one with most poor less clean documents rejected is used (on a
  tie the most lenient); where none gains, or a stratum has too few labels, the rule is off.

On Spark: texts are read once, in Arrow batches; only counts are kept. Labels meet them in a
join on doc_id (one row a document on the label side); an aggregate with one row for each
stratum, rule and grid step, whatever the table's size, gives the cutoffs, one row a stratum.

Defined results: null text counts as empty and fails the base rules; words are compared as
bytes, so no hash can confuse them; a null stratum is a stratum of its own; labels without a
quality or document are ignored, and of several labels of one document the best counts; rows
repeated count as often as they occur; an empty table gives no rows, no labels switch every
rule off; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passlane.llm.common import broadcast_if, cut, ship

#: Characters that part words, and the symbols counted.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Fewer words than this, or a larger percentage of repeated words, fail the base rules.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Bytes of a text whose words are listed at a time.
PIECE = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Rejects where ``1000 * over / under`` (rounded down) reaches the cutoff."""
    name: str
    over: str
    under: str
    grid: tuple[int, ...]


RULES = (
    Rule("symbols", "n_symbols", "n_words", (10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 750, 1000, 1500, 2000)),
    Rule("dup_lines", "n_dup_lines", "n_lines", tuple(range(50, 1000, 50))),
    Rule("repeats", "n_repeat_words", "n_words", tuple(range(10, 201, 10))),
    Rule("long_words", "word_chars", "n_words", tuple(range(5500, 12_001, 250))),
    Rule("short_words", "n_words", "word_chars", tuple(range(200, 601, 10))),
    Rule("shouted", "n_shouted", "n_words", tuple(range(50, 1001, 50))),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted")


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """One number for each distinct pair, and how many there are."""
    found, which = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)
    return which, len(found)


def repeated_words(words: np.ndarray, width: int = 5) -> int:
    """Words (given as numbers) inside windows of ``width`` that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    code = words
    for more in range(1, width):
        code, distinct = _joined(code[:len(words) - more], words[more:])
        if distinct == len(code):
            return 0
    twice = np.bincount(code)[code] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k:n + k] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts named in MEASURES of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    seen: dict[bytes, int] = {}
    numbers, shouted, at = [], 0, 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and raw[end:end + 1].strip():
            end += 1
        words = raw[at:end].split()  # bytes.split parts at the six ASCII blanks only
        numbers.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)))
        shouted += sum(map(bytes.isupper, words))
        at = end
    ids = np.concatenate([np.empty(0, np.int64), *numbers])
    lines, dup, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            n_lines += 1
            dup += line in lines
            lines.add(line)
    return (len(ids), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup,
            repeated_words(ids), n_lines, shouted)


def measured(docs: DataFrame, stratum: Column) -> DataFrame:
    """doc_id, stratum, the MEASURES and base_failed of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = pd.DataFrame([measure(t) for t in b["text"]], columns=list(MEASURES), dtype="int64")
            yield pd.concat([b[["doc_id", "stratum"]].reset_index(drop=True), counts], axis=1)

    rows = docs.select("doc_id", stratum.cast("string").alias("stratum"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInPandas(run, f"doc_id {kind}, stratum string, " + ", ".join(f"{m} long" for m in MEASURES))
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS)
                          | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def value(rule: Rule) -> Column:
    """A rule's number per thousand; 0 where there is nothing to divide by."""
    return F.when(F.col(rule.under) > 0, F.expr(f"1000 * {rule.over} div {rule.under}")).otherwise(F.lit(0))


def level(rule: Rule) -> Column:
    """How many cutoffs of the grid a document reaches."""
    reached = [F.when(value(rule) >= c, 1).otherwise(0) for c in rule.grid]
    return sum(reached[1:], reached[0])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed downward from its largest term while k is under the mean."""
    if k >= n * p:
        return 1.0  # at least about a half; no test has such a level
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                    + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    while k >= 0 and term > total * 1e-18:
        total += term
        term *= k * (1 - p) / ((n - k + 1) * p)
        k -= 1
    return total


def choose(clean: list[int], poor: list[int], n: int, risk: float, level_of_test: float) -> int | None:
    """The step (from 0) of the grid to cut at, or None.

    ``clean`` and ``poor``: documents that reach each step, lenient steps last; ``n``: clean
    documents in all.
    """
    best, gain = None, 0
    for j in reversed(range(len(clean))):
        if binomial_tail(clean[j], n, risk) > level_of_test:
            break
        if poor[j] - clean[j] > gain:
            best, gain = j, poor[j] - clean[j]
    return best


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = 0.005, error: float = 0.05) -> DataFrame:
    """One row per stratum: c_stratum, c_<rule> (null: off), from measured rows and labels (doc_id, quality)."""
    marks = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").alias("l_doc")).agg((F.max("quality") > 0).alias("clean")))
    held = (rows.where(~F.col("base_failed")).join(marks, F.col("doc_id") == F.col("l_doc"))
            .select("stratum", "clean", F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), level(r).alias("level"))
                                                            for i, r in enumerate(RULES)])).alias("x")))
    counts = cut(held.groupBy("stratum", "x.rule", "x.level", "clean").count())
    strata = counts.select("stratum").distinct().count()
    each = error / max(1, strata * len(RULES))

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        out = {"c_stratum": frame["stratum"].iloc[0]}
        for i, rule in enumerate(RULES):
            of, at = frame[frame["rule"] == i], np.zeros((2, len(rule.grid) + 1), np.int64)
            np.add.at(at, (of["clean"].astype(int), of["level"]), of["count"])
            reach = at[:, ::-1].cumsum(axis=1)[:, ::-1]  # documents at this level or a higher one
            j = choose(reach[1, 1:].tolist(), reach[0, 1:].tolist(), int(reach[1, 0]), risk, each)
            out[f"c_{rule.name}"] = None if j is None else rule.grid[j]
        return pd.DataFrame([out]).astype({f"c_{r.name}": "Int64" for r in RULES})

    return counts.groupBy("stratum").applyInPandas(
        pick, "c_stratum string, " + ", ".join(f"c_{r.name} long" for r in RULES))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.005,
          error: float = 0.05) -> DataFrame:
    """doc_id, the MEASURES, stratum, base_failed, kept and failed_rules (names, comma-joined)."""
    rows = cut(measured(docs, F.col(stratum)))
    limits = cut(cutoffs(rows, labels, risk, error))
    limits = broadcast_if(limits, F.coalesce(F.octet_length("c_stratum"), F.lit(0)) + 8 * len(RULES))
    failed = F.array_compact(F.array(*[F.when(value(r) >= F.col(f"c_{r.name}"), F.lit(r.name)) for r in RULES]))
    return (rows.join(limits, F.col("stratum").eqNullSafe(F.col("c_stratum")), "left")
            .withColumn("failed_rules", F.array_join(failed, ","))
            .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
            .drop("c_stratum", *[f"c_{r.name}" for r in RULES]))


def oracle(risk: float = 0.005, error: float = 0.05) -> str:
    """DuckDB SQL for the registered query; the binomial tail is summed from its terms."""
    rules = " UNION ALL ".join(f"""
  SELECT doc_id, r, stratum, clean, {i} AS rule, '{x.name}' AS name,
         CASE WHEN {x.under} > 0 THEN 1000 * {x.over} // {x.under} ELSE 0 END AS value FROM base""" for i, x in enumerate(RULES))
    grid = " UNION ALL ".join(f"SELECT {i} AS rule, unnest({list(x.grid)}) AS c" for i, x in enumerate(RULES))
    return rf"""
WITH marks AS (SELECT doc_id AS l_doc, max(quality) > 0 AS clean FROM labels
               WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, row_number() OVER () AS r, lang AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i + 4], ' ')) AS n FROM g),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM h, range(5) AS z(k) WHERE n > 1 GROUP BY r),
base AS (SELECT w.doc_id, w.r, stratum, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_shouted,
         len(words) < {LEAST_WORDS} OR 100 * coalesce(rep.n, 0) > {MOST_REPEATED} * len(words) AS base_failed, clean
         FROM w LEFT JOIN rep USING (r) LEFT JOIN marks ON doc_id = l_doc),
v AS ({rules}),
held AS (SELECT v.* FROM v JOIN base USING (r) WHERE NOT base_failed AND v.clean IS NOT NULL),
grid AS ({grid}),
step AS (SELECT stratum, rule, c, count(*) FILTER (clean AND value >= c) AS k, count(*) FILTER (NOT clean AND value >= c) AS poor,
         count(*) FILTER (clean) AS n FROM held JOIN grid USING (rule) GROUP BY 1, 2, 3),
tail AS (SELECT *, k < n * {risk} AND list_sum(list_transform(range(0, CASE WHEN k < n * {risk} THEN k + 1 ELSE 1 END),
           lambda i: exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - CASE WHEN i < n THEN lgamma(n - i + 1) ELSE 0 END
                     + i * ln({risk}) + (n - i) * ln(1 - {risk}))))
         <= {error} / ({len(RULES)} * (SELECT count(*) FROM (SELECT DISTINCT stratum FROM held))) AS passes FROM step),
good AS (SELECT *, bool_and(passes) OVER (PARTITION BY stratum, rule ORDER BY c DESC) AS ok FROM tail),
best AS (SELECT stratum, rule, c FROM good WHERE ok AND poor > k
         QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY poor - k DESC, c DESC) = 1),
fails AS (SELECT r, string_agg(name, ',' ORDER BY v.rule) AS failed_rules
          FROM v JOIN best ON v.rule = best.rule AND v.stratum IS NOT DISTINCT FROM best.stratum AND value >= c GROUP BY r)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules IS NULL AS kept, coalesce(failed_rules, '') AS failed_rules
FROM base LEFT JOIN fails USING (r)
"""
