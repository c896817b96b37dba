"""Previous-declaration lookup: a regex theta join, split into three lanes.

A request matches a declaration when the reference pattern and the last-name
pattern both find a match (case-insensitive, unanchored) in the row's reference
and last name, the row is paid, and its amendment is absent, paid or pending.
The first match per request is kept (smallest reference: a deterministic order).

Equal requests are looked up once. Lanes, so only true regexes pay for a nested-loop join
(a *token* is a letter, a digit, ``.`` or a character class without negation):

1. *number*: four tokens and ten digits. References have 14 characters, so such a pattern
   can only match with its digits in place → equi join on the ten digits;
2. *gram*: tokens with a literal run of at least ``GRAM`` characters → equi join on the
   ``GRAM``-gram of its runs that fewest references hold (counted first; a gram that none
   holds ends the request), then the full pattern is checked on the candidates;
3. *index*: any other pattern from which grams can be derived that a match must hold, in
   the reference or in the last name (``must_hold``: an AND of the runs of each alternative, an OR
   over alternatives), long ones (``LONG``) or short ones (``SHORT``) → for each request the column
   and length whose grams fewest rows hold in all, an equi join on the rarest gram of each
   alternative, then the check of both patterns;
4. *scan*: patterns without such grams, or whose grams more than one row in ``COMMON`` holds →
   nested-loop join against a broadcast of the lane's requests, in chunks of at most
   ``max_broadcast`` requests, so the broadcast side has a checked bound and none is dropped.

A row without a last name matches no pattern, the empty one included.

Patterns are compiled on the request table first (``try_reflect``); a pattern
that does not compile is reported, not run (it would fail the whole job).

Every join of requests, postings and declarations is a merge join (``_by_key``): their stored text
repeats itself and is compressed well, so by its files' size the planner takes a side of many times
its bound for a small one and gathers it in the driver. Only chunks of the scan lane are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passlane import schema as S
from passlane.operators.documents import jstrict
from passlane.operators.validate import with_variant
from passlane.session import ensure_checkpoint_dir

GRAM = 5
SHORT = 3
#: Grams of this length keep the rows to check few where short ones are each held by many.
LONG = 6
#: A gram held by more than one row in so many does not narrow a search.
COMMON = 8
CLASS = r"\[[A-Za-z0-9-]+\]"
TOKEN = rf"(?:[A-Za-z0-9.]|{CLASS})"
NUMBER_RE = rf"^{TOKEN}{{4}}[0-9]{{10}}$"
SIMPLE_RE = rf"^{TOKEN}+$"
LAST_NAME_PATH = "$.simpleDeclarationRequest.requestDetail.personalDetails.lastName"


def _ci(p: Column) -> Column:
    return F.concat(F.lit("(?i)"), p)


def _compiles(p: Column) -> Column:
    """The pattern compiles as a (case-insensitive) Java regex; checked without failing."""
    return F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"),
                           _ci(p)).isNotNull()


def intake_lookup_requests(requests: DataFrame) -> DataFrame:
    """Requests with ``reject_reason``: missing or non-string field (bad shape), or a pattern
    that does not compile. Takes JSON bodies (``request_id, raw``) or parsed columns."""
    if "raw" in requests.columns:
        body = F.col("__body")
        requests = with_variant(requests, "raw", "__body").select("request_id", jstrict(body, "$.lastName", "string").alias("lastName"),
                                   jstrict(body, "$.referenceNumber", "string").alias("referenceNumber"))
    missing = F.col("lastName").isNull() | F.col("referenceNumber").isNull()
    bad = ~_compiles(F.col("lastName")) | ~_compiles(F.col("referenceNumber"))
    return requests.withColumn("reject_reason", F.when(missing, F.lit("bad_shape"))
                               .when(bad, F.lit("bad_pattern")))


def eligible_declarations(declarations: DataFrame) -> DataFrame:
    """Paid rows whose amendment is absent, paid or pending, with their last name."""
    amend = F.col("amend_state")
    rows = declarations.where((F.col("state") == S.PAID)
                              & (amend.isNull() | amend.isin(S.PAID, S.PENDING_PAYMENT)))
    return rows.select("charge_reference", "ref_value",
                       F.get_json_object("data", LAST_NAME_PATH).alias("last_name")).where(
        F.col("last_name").isNotNull())


def _grams(text: Column, size: int = GRAM) -> Column:
    """Distinct grams of a text, upper-cased."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - size + 1),
        lambda i: F.upper(F.substring(text, i, F.lit(size)))))).otherwise(F.array().cast("array<string>"))


def must_hold(pattern: Column, size: int = SHORT) -> Column:
    """For each alternative of a pattern the grams that whatever matches it must hold; null if it is unknown.

    Groups and escapes are not looked into. What may be absent (``?``, ``*``, ``{...}``) and what
    may be several things (``.``, classes) part the runs of letters and digits; of ``x+`` the first
    and the last ``x`` belong to the runs before and after it."""
    plain = F.regexp_replace(pattern, r"\[\^?\]?[^\]]*\]", ".")
    plain = F.regexp_replace(plain, r".(?:[?*]|\{[^}]*\})[?+]?", ".")
    plain = F.regexp_replace(plain, r"([A-Za-z0-9])\+[?+]?", "$1.$1")
    runs = lambda alt: F.regexp_extract_all(alt, F.lit(f"[A-Za-z0-9]{{{size},}}"), 0)
    found = F.transform(F.split(plain, r"\|"), lambda alt: F.array_distinct(F.flatten(F.transform(
        runs(alt), lambda run: _grams(run, size)))))
    return F.when(~pattern.rlike(r"[()\\]|\[[^\]]*[\[&]") & F.forall(found, lambda g: F.size(g) > 0), found)


def _lane(requests: DataFrame) -> DataFrame:
    """Adds ``lane``, and ``grams``: those every match must hold."""
    ref = F.col("referenceNumber")
    runs = F.regexp_extract_all(F.regexp_replace(ref, CLASS, "."), F.lit(f"[A-Za-z0-9]{{{GRAM},}}"), 0)
    lane = (F.when(ref.rlike(NUMBER_RE), F.lit("number"))
            .when(ref.rlike(SIMPLE_RE) & (F.size(runs) > 0), F.lit("gram"))
            .otherwise(F.lit("scan")))
    return (requests.withColumn("lane", lane)
            .withColumn("grams", F.array_distinct(F.flatten(F.transform(runs, lambda run: _grams(run))))))


def _by_key(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow: sorted by the key in the executors, whatever their estimated size."""
    return left.join(right.hint("merge"), on, how)


def _verify(df: DataFrame) -> DataFrame:
    return df.where(F.regexp_like(F.col("charge_reference"), _ci(F.col("referenceNumber")))
                    & F.regexp_like(F.col("last_name"), _ci(F.col("lastName")))).select(
        "lastName", "referenceNumber", "charge_reference")


def _index_lane(pairs: DataFrame, decl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, requests searched by the index) of requests with any pattern."""
    columns = (("referenceNumber", "charge_reference"), ("lastName", "last_name"))
    ways = [(asked, held, size) for asked, held in columns for size in (SHORT, LONG)]
    alternatives = [pairs.select("lastName", "referenceNumber", F.lit(f"{held} {size}").alias("held_in"),
                                 F.posexplode(must_hold(F.col(asked), size)).alias("alt", "grams")) for asked, held, size in ways]
    asked = reduce(DataFrame.unionByName, alternatives).withColumn("gram", F.explode("grams")).drop("grams")
    postings = [decl.select(F.lit(f"{held} {size}").alias("held_in"), F.explode(_grams(F.col(held), size)).alias("gram"),
                            "charge_reference", "last_name") for _, held, size in ways]
    wanted = asked.select("held_in", "gram").distinct()
    # kept in the shared folder: the counts and the search read them
    postings = _by_key(reduce(DataFrame.unionByName, postings), wanted, ["held_in", "gram"], "left_semi").checkpoint()
    counts = postings.groupBy("held_in", "gram").agg(F.count(F.lit(1)).alias("n"))
    key = ["lastName", "referenceNumber"]
    counted = _by_key(asked, counts, ["held_in", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy(*key, "held_in", "alt").agg(F.min(F.struct("n", "gram")).alias("r"))
    cost = rarest.groupBy(*key, "held_in").agg(F.sum("r.n").alias("cost"))
    most = decl.count() / COMMON
    chosen = (cost.groupBy(*key).agg(F.min(F.struct("cost", "held_in")).alias("best"))
              .where(F.col("best.cost") <= F.lit(most)).select(*key, F.col("best.held_in").alias("held_in")).checkpoint())
    searched = _by_key(rarest, chosen, [*key, "held_in"]).select(*key, "held_in", "r.gram")
    return _verify(_by_key(searched, postings, ["held_in", "gram"])).distinct(), chosen.select(*key)


def lookup_matches(requests: DataFrame, declarations: DataFrame, max_broadcast: int = 10_000
                   ) -> DataFrame:
    """All (request_id, charge_reference) pairs that match (before first-match)."""
    ensure_checkpoint_dir(declarations.sparkSession)
    good = intake_lookup_requests(requests).where(F.col("reject_reason").isNull())
    pairs = _lane(good.select("lastName", "referenceNumber").distinct())
    # names are taken from the documents once; every lane reads these few columns
    decl = eligible_declarations(declarations).checkpoint()

    number = pairs.where(F.col("lane") == "number").select(
        "lastName", "referenceNumber", F.expr("right(referenceNumber, 10)").alias("digits"))
    parts = [_verify(_by_key(number, decl.withColumn("digits", F.expr("right(charge_reference, 10)")), "digits"))]

    by_gram = pairs.where(F.col("lane") == "gram")
    asked = by_gram.select("lastName", "referenceNumber", F.size("grams").alias("asked"), F.explode("grams").alias("gram"))
    held = decl.select("*", F.explode(_grams(F.col("charge_reference"))).alias("gram"))
    counts = _by_key(held, asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (_by_key(asked, counts, "gram").groupBy("lastName", "referenceNumber").agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count(F.lit(1)).alias("found"), F.first("asked").alias("asked"))
        .where(F.col("found") == F.col("asked")).select("lastName", "referenceNumber", "gram"))
    parts.append(_verify(_by_key(rarest, held, "gram")))

    rest = pairs.where(F.col("lane") == "scan").select("lastName", "referenceNumber")
    indexed, chosen = _index_lane(rest, decl)
    parts.append(indexed)
    scan = _by_key(rest, chosen, ["lastName", "referenceNumber"], "left_anti")
    n_scan = scan.count()
    if n_scan:
        chunks = max(1, -(-n_scan // max_broadcast))
        scan = scan.withColumn("__chunk", F.pmod(F.hash("lastName", "referenceNumber"), F.lit(chunks)))
        for c in range(chunks):
            side = F.broadcast(scan.where(F.col("__chunk") == c).drop("__chunk"))
            parts.append(_verify(decl.join(side, F.regexp_like(
                F.col("charge_reference"), _ci(F.col("referenceNumber"))))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _by_key(good.select("request_id", "lastName", "referenceNumber"), out, ["lastName", "referenceNumber"]).select(
        "request_id", "charge_reference")


def first_match(matches: DataFrame) -> DataFrame:
    """One row per request: the smallest matching reference and the number of matches.

    A grouped ``min``/``count`` (partial aggregation), not a window, so a request
    matching a third of the table is not gathered into one task."""
    return matches.groupBy("request_id").agg(
        F.min("charge_reference").alias("charge_reference"),
        F.count(F.lit(1)).cast("bigint").alias("n_matches"))


def previous_declaration_lookup(requests: DataFrame, declarations: DataFrame,
                                max_broadcast: int = 10_000) -> DataFrame:
    """First match per request joined to its declaration row."""
    firsts = first_match(lookup_matches(requests, declarations, max_broadcast))
    return _by_key(firsts, declarations, "charge_reference")
