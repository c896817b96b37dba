"""Work lists: lifecycle predicates over the declarations table, and age filters.

Every function is a filter ``DataFrame → DataFrame`` on plain columns, so Catalyst
pushes the state / flag / timestamp predicates into the parquet scan (and prunes
``state`` partitions when the table is written partitioned by state).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passlane import schema as S

RECEIPT_DATE_PATH = "$.simpleDeclarationRequest.requestCommon.receiptDate"
RECEIPT_DATE_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"


def _ts(as_of) -> Column:
    """``as_of`` as a TIMESTAMP_NTZ literal built from text, so no time zone is involved."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def minus_seconds(as_of, seconds: int | float) -> Column:
    return (_ts(as_of) - F.make_interval(secs=F.lit(seconds).cast("decimal(18,6)"))).cast("timestamp_ntz")


# -- predicates (usable inside other jobs) ----------------------------------

def is_unpaid() -> Column:
    return F.col("state").isin(*S.UNPAID_STATES)


def is_unpaid_amendment() -> Column:
    return (F.col("state") == S.PAID) & F.col("amend_state").isin(*S.UNPAID_STATES)


def is_paid_for_submission() -> Column:
    return (F.col("state") == S.PAID) & ~F.col("sent_to_hod")


def is_amendment_for_submission() -> Column:
    return ((F.col("state") == S.PAID) & F.col("sent_to_hod")
            & (F.col("amend_state") == S.PAID) & (F.col("amend_sent_to_hod") == F.lit(False)))


def is_deletable() -> Column:
    no_amendment = F.col("amend_state").isNull() & F.col("amend_sent_to_hod").isNull()
    amendment_sent = (F.col("amend_state") == S.PAID) & (F.col("amend_sent_to_hod") == F.lit(True))
    return (F.col("state") == S.PAID) & F.col("sent_to_hod") & (no_amendment | amendment_sent)


def is_failed() -> Column:
    return F.col("state") == S.SUBMISSION_FAILED


def is_failed_amendment() -> Column:
    return F.col("amend_state") == S.SUBMISSION_FAILED


# -- the seven work lists ---------------------------------------------------

def unpaid_declarations(decl: DataFrame) -> DataFrame:
    return decl.where(is_unpaid())


def unpaid_amendments(decl: DataFrame) -> DataFrame:
    return decl.where(is_unpaid_amendment())


def paid_for_submission(decl: DataFrame) -> DataFrame:
    """Paid and not yet sent; amendment columns are not looked at."""
    return decl.where(is_paid_for_submission())


def amendments_for_submission(decl: DataFrame) -> DataFrame:
    """Paid, sent, amendment paid and not sent (a missing amend flag does not match)."""
    return decl.where(is_amendment_for_submission())


def deletable_declarations(decl: DataFrame) -> DataFrame:
    return decl.where(is_deletable())


def failed_declarations(decl: DataFrame) -> DataFrame:
    return decl.where(is_failed())


def failed_amendments(decl: DataFrame) -> DataFrame:
    """Amendment submission failed; the row's own state is not checked."""
    return decl.where(is_failed_amendment())


# -- age filters --------------------------------------------------------------

def stale_declarations(decl: DataFrame, as_of, timeout_seconds: int = S.PAYMENT_TIMEOUT_SECONDS
                       ) -> DataFrame:
    """Unpaid rows last updated strictly before ``as_of - timeout``."""
    return decl.where(is_unpaid() & (F.col("last_updated") < minus_seconds(as_of, timeout_seconds)))


def stale_amendments(decl: DataFrame, as_of, timeout_seconds: int = S.PAYMENT_TIMEOUT_SECONDS
                     ) -> DataFrame:
    return decl.where(is_unpaid_amendment()
                      & (F.col("last_updated") < minus_seconds(as_of, timeout_seconds)))


def receipt_timestamp(data: Column | None = None) -> Column:
    """receiptDate of the original document; null when missing or not in the strict format."""
    data = F.col("data") if data is None else data
    text = F.get_json_object(data, RECEIPT_DATE_PATH)
    # a zone-free cast: the session time zone has gaps that these times do not
    return F.when(text.rlike(RECEIPT_DATE_SHAPE), F.substring(text, 1, 19).try_cast("timestamp_ntz"))


def with_receipt_at(decl: DataFrame) -> DataFrame:
    """Adds ``receipt_at``, the receipt date as a column: for tables at write, so that the age
    filter reaches the scan and skips row groups. The original document never changes."""
    return decl.withColumn("receipt_at", receipt_timestamp())


def retention_expired(decl: DataFrame, as_of, hold_seconds: int = S.DELETION_HOLD_SECONDS
                      ) -> DataFrame:
    """Deletable rows whose receipt date plus the hold (whole minutes) is before ``as_of``.

    A stored table has the date as ``receipt_at``, and both predicates are pushed to the scan;
    else the state predicate runs first, so only deletable rows have their document parsed.
    A receiptDate that does not parse never expires.
    """
    before = minus_seconds(as_of, 60 * int(hold_seconds // 60))
    at = F.col("receipt_at") if "receipt_at" in decl.columns else receipt_timestamp()
    return decl.where(is_deletable()).where(at < before)


def is_zero_pound(data: Column | None = None) -> Column:
    data = F.col("data") if data is None else data
    total = F.coalesce(F.get_json_object(
        data, "$.simpleDeclarationRequest.requestDetail.liabilityDetails.grandTotalGBP"), F.lit(""))
    return F.lower(total) == F.lit("0.00")
