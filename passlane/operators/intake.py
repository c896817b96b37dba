"""Intake: reference numbering, stamping, validation and the accept / reject split.

``assign_references`` gives every eligible submission the next counter value in
arrival order, gap-free, without ever sorting the whole batch in one task and without
moving documents for it:

1. checkpoint the order keys alone, so that bodies are looked at once for them;
2. a whole key that identifies its row is found again without a join by it: the keys of a block of
   ``BLOCK`` values are one bitmap, and a row's number is the count of keys in the blocks before
   its own, and of bits up to its own. Blocks are broadcast, up to ``MOST_BLOCKS`` of them (4 KB
   each); documents stay where they are read;
3. any other order (several columns, text, keys that repeat or are null, keys too far apart):
   range-partition the keys, count them per partition (one row per partition), turn the counts
   into offsets, add ``row_number`` within each partition, and join the numbers to the documents
   on the order key, the one shuffle of documents.

Numbers are consumed by every submission that reaches the counter, including
those that then fail validation, so accepted references have gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passlane import schema as S
from passlane.functions.refs import decode_reference, encode_reference
from passlane.operators import locks as L
from passlane.operators.validate import validate_documents, with_variant
from passlane.operators.worklists import _ts
from passlane.session import ensure_checkpoint_dir

DECLARATION_PATH = "$.simpleDeclarationRequest.requestDetail.declarationHeader.chargeReference"


#: Key values in one bitmap, and bitmaps that may be broadcast.
BLOCK, MOST_BLOCKS = 1 << 15, 1 << 13


def assign_references(df: DataFrame, start: int, order_cols: list[str],
                      partitions: int | None = None, value_col: str = "ref_value") -> DataFrame:
    """Adds ``value_col`` = start + 1, start + 2, ... in the order of ``order_cols``, which
    identify a row."""
    ensure_checkpoint_dir(df.sparkSession)
    order = [F.col(c) for c in order_cols]
    keys = df.select(*order)
    if len(order_cols) == 1 and keys.dtypes[0][1] in ("int", "bigint"):
        block = F.shiftright(order[0].cast("long"), BLOCK.bit_length() - 1)
        keys = keys.select(order[0], block.alias("__block")).repartition("__block").checkpoint()
        if (blocks := _blocks(keys, order[0])) is not None:
            bit = f"int(`{order_cols[0]}` & {BLOCK - 1})"
            number = (f"int({int(start)} + __before + bitmap_count(substring(__bits, 1, shiftright({bit}, 3))) + bit_count(int("
                      f"conv(hex(substring(__bits, shiftright({bit}, 3) + 1, 1)), 16, 10)) & (shiftleft(2, {bit} & 7) - 1)))")
            return df.join(F.broadcast(blocks), block == blocks["__block"]).select(
                *[df[c] for c in df.columns], F.expr(number).alias(value_col))
        keys = keys.select(*order)
    ranged = keys.repartitionByRange(partitions, *order) if partitions else keys.repartitionByRange(*order)
    staged = ranged.withColumn("__part", F.spark_partition_id()).checkpoint(eager=True)
    counts = staged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row per shuffle partition: a window without partitioning is bounded by their number
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0))
                            .cast("long").alias("__offset"))
    within = Window.partitionBy("__part").orderBy(*order)
    numbers = staged.join(F.broadcast(offsets), "__part").select(
        *[F.col(c).alias(f"__key_{c}") for c in order_cols],
        (F.lit(int(start)) + F.col("__offset") + F.row_number().over(within)).cast("int").alias(value_col))
    same = F.lit(True)
    for c in order_cols:
        same = same & df[c].eqNullSafe(numbers[f"__key_{c}"])
    # by a shuffle: documents must not be broadcast to the few tasks that hold the numbers; hashed on
    # the numbers, so that documents pass by and are never sorted (and spilled)
    return df.join(numbers.hint("shuffle_hash"), same).drop(*[f"__key_{c}" for c in order_cols])


def _blocks(keys: DataFrame, key: Column) -> DataFrame | None:
    """For each block its keys as a bitmap (``__bits``) and the count of keys in the blocks before it
    (``__before``); None if the blocks are too many, or a key repeats or is null."""
    if keys.select("__block").distinct().limit(MOST_BLOCKS + 1).count() > MOST_BLOCKS:
        return None
    made = keys.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"), F.bitmap_construct_agg(
        key.cast("long").bitwiseAND(F.lit(BLOCK - 1))).alias("__bits")).checkpoint()
    if not made.where(F.col("__block").isNull() | (F.col("__n") != F.bitmap_count("__bits"))).isEmpty():
        return None
    # a bounded number of rows: see above
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return made.select("__block", "__bits", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))


def dispatch_slots(numbered: DataFrame, elements: int = 1, per_seconds: int = 1,
                   seq_col: str = "seq") -> DataFrame:
    """Throttle as data: at most ``elements`` rows per ``per_seconds``.

    ``slot = floor((seq - 1) / elements)`` on a gap-free 1-based numbering, and
    ``offset_seconds = slot * per_seconds`` is when the row may be sent."""
    slot = F.floor((F.col(seq_col) - 1) / F.lit(int(elements))).cast("bigint")
    return (numbered.withColumn("slot", slot)
            .withColumn("offset_seconds", (F.col("slot") * F.lit(int(per_seconds))).cast("bigint")))


def is_json_object(raw: str = "raw"):
    """Whether a body is JSON, and an object: valid JSON that begins with a brace is one."""
    return F.expr(rf"coalesce(`{raw}` RLIKE '^[ \t\r\n]*[{{]' AND try_parse_json(`{raw}`) IS NOT NULL, false)")


def eligible_submissions(raw_df: DataFrame) -> DataFrame:
    """Submissions that reach the counter: a JSON object with a correlation id."""
    return raw_df.where(F.col("correlation_id").isNotNull() & is_json_object())


def number_submissions(raw_df: DataFrame, start: int, order_col: str = "seq",
                       partitions: int | None = None) -> DataFrame:
    """Submissions that reach the counter, numbered."""
    numbered = assign_references(eligible_submissions(raw_df), start, [order_col], partitions)
    return numbered.withColumn("charge_reference", encode_reference(F.col("ref_value")))


def _document_parts(df: DataFrame) -> DataFrame:
    """Split a document into journey data, which stamping leaves alone, and the rest (JSON text)."""
    m = "try_variant_get(__doc, '$', 'map<string,variant>')"
    return (df.withColumn("__journey", F.expr("try_variant_get(__parsed, '$.journeyData', 'variant')"))
            .withColumn("__journey_ok", F.expr("coalesce(schema_of_variant(__journey) LIKE 'OBJECT<%', false)"))
            .withColumn("journey_data", F.to_json(F.col("__journey")))
            .withColumn("data", F.expr(
                f"to_json(to_variant_object(map_filter({m}, (k, v) -> k != 'journeyData')))")))


def validated_submissions(raw_df: DataFrame, start: int, order_col: str = "seq",
                          partitions: int | None = None) -> DataFrame:
    """Numbered, stamped and validated submissions (one row each, ``errors`` array)."""
    numbered = number_submissions(raw_df, start, order_col, partitions)
    return _document_parts(validate_documents(numbered, "raw", "charge_reference"))


def accept_submissions(validated: DataFrame, as_of, sent_to_hod: bool = False) -> DataFrame:
    """Valid submissions with journey data, as new declaration rows."""
    ok = validated.where((F.size("errors") == 0) & F.col("__journey_ok"))
    return ok.select(
        "charge_reference", "ref_value",
        F.lit(S.PENDING_PAYMENT).alias("state"),
        F.lit(None).cast("string").alias("amend_state"),
        F.lit(bool(sent_to_hod)).alias("sent_to_hod"),
        F.lit(None).cast("boolean").alias("amend_sent_to_hod"),
        "correlation_id",
        F.lit(None).cast("string").alias("amend_correlation_id"),
        "journey_data", "data",
        F.lit(None).cast("string").alias("amend_data"),
        _ts(as_of).alias("last_updated"),
    )


def rejected_submissions(raw_df: DataFrame, validated: DataFrame, order_col: str = "seq"
                         ) -> DataFrame:
    """Every refused submission with its error texts (``seq``, ``ref_value``, ``errors``).

    Bodies that are not JSON objects, or come without a correlation id, are refused
    before numbering (``ref_value`` null).
    """
    early = raw_df.where(F.col("correlation_id").isNull() | ~is_json_object()).select(
        order_col, F.lit(None).cast("int").alias("ref_value"),
        F.when(F.col("correlation_id").isNull(), F.array(F.lit("Missing X-Correlation-ID header")))
        .otherwise(F.array(F.lit("not_an_object"))).alias("errors"))
    late = validated.where((F.size("errors") > 0) | ~F.col("__journey_ok")).select(
        order_col, "ref_value",
        F.when(F.size("errors") > 0, F.transform("errors", lambda e: e["message"]))
        .otherwise(F.array(F.lit("journeyData is missing or not an object"))).alias("errors"))
    return early.unionByName(late)


# -- amendments -------------------------------------------------------------------

def accept_amendments(raw_df: DataFrame, declarations: DataFrame, locks: DataFrame, as_of,
                      order_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(after-images of amended rows, outcomes per amendment).

    Steps: correlation id required → validate (no stamping) → reference read from
    the document and decoded → live lock gives 423 → key join with the table (unmatched
    is an error) → journey data required. The amendment overwrites any earlier amendment; within one
    batch the last arrival per key wins. State, sent flag and data are kept.
    """
    has_cid = F.col("correlation_id").isNotNull()
    v = _document_parts(validate_documents(raw_df.where(has_cid), "raw"))
    # what decides an amendment, without its document
    v = v.select(order_col, (F.size("errors") > 0).alias("__invalid"), "__journey_ok", decode_reference(
        F.expr(f"try_variant_get(__doc, '{DECLARATION_PATH}', 'string')")).alias("__ref"))
    held = L.live_locks(locks, as_of).select(F.col("lock_id").alias("__lock")).distinct()
    keys = declarations.select(F.col("ref_value").alias("__key"))
    v = (v.join(keys, v["__ref"] == keys["__key"], "left")
         .join(held, v["__ref"] == held["__lock"], "left"))
    outcome = (F.when(F.col("__invalid"), F.lit("invalid"))
               .when(F.col("__ref").isNull(), F.lit("bad_reference"))
               .when(F.col("__lock").isNotNull(), F.lit("locked"))
               .when(F.col("__key").isNull(), F.lit("not_found"))
               .when(~F.col("__journey_ok"), F.lit("no_journey_data"))
               .otherwise(F.lit("accepted")))
    v = v.select(order_col, F.col("__ref").alias("ref_value"), outcome.alias("outcome"))
    outcomes = v.unionByName(
        raw_df.where(~has_cid).select(order_col, F.lit(None).cast("int").alias("ref_value"),
                                      F.lit("missing_correlation_id").alias("outcome")))
    # last arrival per key wins: a partial aggregate, no per-key collection
    winners = (v.where(F.col("outcome") == "accepted").groupBy("ref_value")
               .agg(F.max(order_col).alias("__last")))
    # the winners' documents are made where they are read, and only if they are asked for: plain columns,
    # which the optimizer drops where a generator would keep the whole body in the joins
    bodies = raw_df.where(has_cid).withColumn("__parsed", F.expr("try_parse_json(`raw`)")).withColumn("__doc", F.col("__parsed"))
    bodies = _document_parts(bodies).select(
        order_col, F.col("correlation_id").alias("__cid"), F.col("journey_data").alias("__journey_data"), F.col("data").alias("__data"),
        decode_reference(F.expr(f"try_variant_get(__doc, '{DECLARATION_PATH}', 'string')")).alias("__ref"))
    # joined by the reference alone, as the table is, so that documents are moved once; the place in the
    # order is compared, not joined by
    latest = bodies.join(winners, (F.col("__ref") == F.col("ref_value")) & (F.col(order_col) >= F.col("__last"))
                         & (F.col(order_col) <= F.col("__last"))).drop("__ref", "__last", order_col)
    new = {
        "amend_state": F.lit(S.PENDING_PAYMENT),
        "amend_sent_to_hod": F.lit(False),
        "amend_correlation_id": F.col("__cid"),
        "journey_data": F.col("__journey_data"),
        "amend_data": F.col("__data"),
        "last_updated": _ts(as_of),
    }
    # a table stored without documents gives after-images without the original's
    kept = [c for c in S.DECLARATION_COLUMNS if c in new or c in declarations.columns]
    after = declarations.join(latest, "ref_value").select(
        *[new[c].alias(c) if c in new else c for c in kept],
        *[c for c in declarations.columns if c not in S.DECLARATION_COLUMNS])
    return after, outcomes
