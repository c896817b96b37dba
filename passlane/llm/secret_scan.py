"""Secret scan with a trigram inverted index (DataFrame functions only).

From each rule's pattern a Boolean query over trigrams is derived: a list of alternatives,
each a set of trigrams that every match must hold. The index maps each trigram that occurs in
a query to the documents whose lower-cased text holds it; postings are intersected for each
alternative, and only the candidates of a rule are verified with its pattern. A rule with an
alternative that has no trigram of three certain characters scans every document.

Positions come from the pattern's matches and the text between them (``regexp_extract_all``
and ``split``), both over the whole text.

Defined results: null counts as empty and has no spans; overlapping spans of different kinds
all stay; postings name a document by a 64-bit hash of its row, so a clash only adds a
candidate; repeated rows are reported each; an empty table gives no rows.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least characters of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules, in the order that ties follow. A run of hex digits or of capitals
# and digits that is too short is followed by no other match inside it, so the least length may
# stand in the pattern; for `assign` it may not.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + MORE
#: Beyond this many ways a pattern forks no more; its query then asks for less, never for more.
MOST_WAYS = 64


# -- Boolean trigram queries

def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams (of the lower-cased text) that every match must hold; None: no such query.

    A way is a list of literal runs; the last one is still open. Optional parts fork a way,
    small character classes too; anything else uncertain closes the open run.
    """
    def close(ways):
        return {(*(run for run in w if len(run) > 2), "") for w in ways}

    def extend(ways, tree):
        for op, arg in tree:
            if op is ops.LITERAL:
                c = chr(arg).lower()
                ways = {(*w[:-1], w[-1] + c) for w in ways} if len(c) == 1 else close(ways)
            elif op is ops.IN and all(o is ops.LITERAL for o, _ in arg) and len(ways) * len(arg) <= MOST_WAYS:
                ways = {(*w[:-1], w[-1] + chr(x).lower()) for w in ways for _, x in arg}
            elif op is ops.SUBPATTERN:
                ways = extend(ways, arg[-1])
            elif op is ops.BRANCH:
                ways = set().union(*(extend(ways, b) for b in arg[1]))
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
                low, high, inner = arg
                if low == 0:
                    ways = ways | extend(ways, inner) if high == 1 and len(ways) * 2 <= MOST_WAYS else close(ways)
                else:
                    for _ in range(min(low, 8)):
                        ways = extend(ways, inner)
                    ways = ways if low == high and low <= 8 else close(ways)
            elif op is not ops.AT:
                ways = close(ways)
        return ways

    found = {frozenset(run[i:i + 3] for run in way for i in range(len(run) - 2))
             for way in extend({("",)}, parser.parse(pattern))}
    if not all(found):
        return None
    return sorted((a for a in found if not any(b < a for b in found)), key=sorted)


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, trigrams: Iterable[str]) -> DataFrame:
    """Inverted index of the given trigrams: (trigram, doc), one row for each that a text holds."""
    low = F.lower(F.coalesce("text", F.lit("")))
    wanted = F.array(*[F.lit(t) for t in sorted(trigrams)])
    return docs.select(_key().alias("doc"), low.alias("_low")).select(
        "doc", F.explode(F.filter(wanted, lambda t: F.col("_low").contains(t))).alias("trigram"))


def candidates(docs: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """(doc, kinds): documents whose postings satisfy the query of a rule, and those rules."""
    spark = docs.sparkSession
    asks = [(rule.kind, k, t, 1 << i, len(sorted(a)[:62]))
            for rule in rules if (q := trigram_query(rule.pattern)) is not None
            for k, a in enumerate(q) for i, t in enumerate(sorted(a)[:62])]
    schema = "kind string, way int, trigram string, bit long, need int"
    query = spark.createDataFrame(asks, schema)  # bounded by the rules
    held = postings(docs, {a[2] for a in asks}).join(F.broadcast(query), "trigram")
    return (held.groupBy("doc", "kind", "way", "need").agg(F.bit_or("bit").alias("held"))
            .where(F.bit_count("held") == F.col("need"))
            .groupBy("doc").agg(F.collect_set("kind").alias("kinds")))


# -- verification

def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Matches of a rule as structs (start, order, end, kind), from the text between them."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.arrays_zip(
        F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(hits)), F.length).alias("gap"),
        F.transform(hits, F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("part"))
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"
    none = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(
            x["part"] >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, out: str = "secret_spans") -> DataFrame:
    """``docs`` with ``out``: array of (start, order, end, kind), sorted; code points, end exclusive.

    It replaces a column of that name."""
    indexed = [r for r in rules if trigram_query(r.pattern) is not None]
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    found = []
    for order, rule in enumerate(rules):
        due = F.array_contains("_kinds", rule.kind) if rule in indexed else text.rlike(rule.pattern)
        found.append(F.when(due, _spans(text, rule, order)).otherwise(none))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    if indexed:
        picked = candidates(docs, indexed).select(F.col("doc").alias("_doc"), F.col("kinds").alias("_kinds"))
        docs = docs.withColumn("_row", _key()).join(picked, F.col("_row") == F.col("_doc"), "left")
    return docs.select(*kept, F.array_sort(F.concat(*found)).alias(out))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """One row per document: doc_id, n_<kind> of the base rules, base_sha256, spans."""
    found = find_secrets(docs.select("doc_id", "text"), rules).select("doc_id", "secret_spans")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    of_base = F.filter("secret_spans", lambda s: s["kind"].isin([r.kind for r in base]))
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in base],
                        F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]",
                 length_column: str = "n_chars") -> DataFrame:
    """``docs`` with every found span (overlapping ones as one) replaced by ``mark`` in ``text``.

    If there is a ``length_column``, it follows the text of the documents that change.
    """
    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        put = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, put).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate("_secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                         lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    changed = F.size("_secret_spans") > 0
    out = find_secrets(docs, rules, "_secret_spans").withColumn("_masked", F.when(changed, masked).otherwise(F.col("text")))
    new = {"text": F.col("_masked")}
    if length_column in docs.columns:
        new[length_column] = F.when(changed, F.length("_masked").cast("long")).otherwise(F.col(length_column))
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
