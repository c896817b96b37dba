"""Domain vocabulary, table schemas and the fixed values the lifecycle depends on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the service this library re-expresses; do not edit)
# ---------------------------------------------------------------------------

# Row states, in declaration order.
PENDING_PAYMENT = "pending-payment"
PAID = "paid"
SUBMISSION_FAILED = "submission-failed"
PAYMENT_FAILED = "payment-failed"
PAYMENT_CANCELLED = "payment-cancelled"
STATES = (PENDING_PAYMENT, PAID, SUBMISSION_FAILED, PAYMENT_FAILED, PAYMENT_CANCELLED)
UNPAID_STATES = (PENDING_PAYMENT, PAYMENT_CANCELLED, PAYMENT_FAILED)

# Payment notification statuses.
SUCCESSFUL = "Successful"
FAILED = "Failed"
CANCELLED = "Cancelled"

# Charge reference: X, check character, PR, ten zero-padded digits.
# Check = (9*48 + 10*50 + sum(weight_i * digit_i)) mod 23, mapped through the alphabet.
REFERENCE_WEIGHTS = (9, 10, 11, 12, 13, 8, 7, 6, 5, 4, 3, 2)
REFERENCE_FIXED_VALUES = (48, 50)
CHECK_ALPHABET = "ABCDEFGHXJKLMNYPQRSTZVW"
REFERENCE_PATTERN = r"^X([A-Z])PR(\d{10})$"
REFERENCE_LENGTH = 14

# Receipt e-mail values.
RECEIPT_TEMPLATE_ID = "passengers_payment_confirmation"
SUBJECT_NON_ZERO = "Receipt for payment on goods brought into the UK - Reference number "
SUBJECT_ZERO = "Receipt for declaration of goods brought into Northern Ireland - Reference number "
RECEIPT_DATE_FORMAT = "dd MMMM yyyy"
RECEIPT_TIME_FORMAT = "hh:mm a"
RECEIPT_PARAMETER_KEYS = (
    "subject", "NAME", "DATE", "PLACEOFARRIVAL", "DATEOFARRIVAL", "TIMEOFARRIVAL",
    "REFERENCE", "TOTAL", "TOTALEXCISEGBP", "TOTALCUSTOMSGBP", "TOTALVATGBP",
    "TRAVELLINGFROM", "AllITEMS",
)

# Audit event constants (the audit source is the application name, a parameter).
AUDIT_TYPE = "passengerdeclaration"
AUDIT_TRANSACTION_NAME = "passengerdeclarationsubmitted"

# Lifecycle defaults (durations).
PAYMENT_TIMEOUT_SECONDS = 14 * 24 * 3600
DELETION_HOLD_SECONDS = 5 * 24 * 3600
LOCK_TTL_SECONDS = 300
SUBMISSION_INTERVAL_SECONDS = 30 * 60

# Metric names of the five state gauges.
GAUGE_NAMES = {
    PENDING_PAYMENT: "pending-payment-counter",
    PAID: "payment-complete-counter",
    PAYMENT_FAILED: "payment-failed-counter",
    PAYMENT_CANCELLED: "payment-cancelled-counter",
    SUBMISSION_FAILED: "failed-submission-counter",
}

# The text of a missing-required-properties error.
MISSING_REQUIRED_TEXT = "object has missing required properties ({names})"

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------

DECLARATIONS = T.StructType([
    T.StructField("charge_reference", T.StringType(), False),
    T.StructField("ref_value", T.IntegerType(), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("amend_state", T.StringType(), True),
    T.StructField("sent_to_hod", T.BooleanType(), False),
    T.StructField("amend_sent_to_hod", T.BooleanType(), True),
    T.StructField("correlation_id", T.StringType(), False),
    T.StructField("amend_correlation_id", T.StringType(), True),
    T.StructField("journey_data", T.StringType(), False),
    T.StructField("data", T.StringType(), False),
    T.StructField("amend_data", T.StringType(), True),
    T.StructField("last_updated", T.TimestampNTZType(), False),
])
DECLARATION_COLUMNS = [f.name for f in DECLARATIONS.fields]
# What only jobs that read documents need: left out where a table is stored without them.
DOCUMENT_COLUMNS = ["journey_data", "data", "amend_data"]
# As stored: with the receipt date of the original document as a column of its own.
STORED_DECLARATIONS = T.StructType([*DECLARATIONS.fields, T.StructField("receipt_at", T.TimestampNTZType(), True)])

LOCKS = T.StructType([
    T.StructField("lock_id", T.IntegerType(), False),
    T.StructField("last_updated", T.TimestampNTZType(), False),
    T.StructField("last_updated_date", T.TimestampNTZType(), True),
])

NOTIFICATIONS = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("status", T.StringType(), True),
    T.StructField("reference", T.StringType(), True),
])

SUBMISSION_RESPONSES = T.StructType([
    T.StructField("charge_reference", T.StringType(), False),
    T.StructField("http_status", T.IntegerType(), True),
    T.StructField("is_amendment", T.BooleanType(), False),
])

LOOKUP_REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("lastName", T.StringType(), True),
    T.StructField("referenceNumber", T.StringType(), True),
])

# Typed submission payload: the fields the downstream system accepts. Header fields
# portOfEntryName, uccRelief, ukVATPaid, ukExcisePaid and item fields
# valueCurrencyName, originCountryName are accepted at intake but not forwarded.
_S = T.StringType()
_B = T.BooleanType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


def _item(extra, reliefs):
    return _struct(
        ("commodityDescription", _S), *extra,
        ("goodsValue", _S), ("valueCurrency", _S), ("originCountry", _S),
        ("exchangeRate", _S), ("exchangeRateDate", _S), ("goodsValueGBP", _S),
        ("VATRESClaimed", _B), ("exciseGBP", _S), ("customsGBP", _S), ("vatGBP", _S),
        *reliefs, ("euCustomsRelief", _B), ("madeIn", _S),
    )


TOBACCO_ITEM = _item([("quantity", _S), ("weight", _S)], [("ukVATPaid", _B), ("ukExcisePaid", _B)])
ALCOHOL_ITEM = _item([("volume", _S)], [("ukVATPaid", _B), ("ukExcisePaid", _B)])
OTHER_ITEM = _item([("quantity", _S)], [("ukVATPaid", _B), ("uccRelief", _B)])

PAYLOAD = _struct(
    ("simpleDeclarationRequest", _struct(
        ("requestCommon", _struct(
            ("receiptDate", _S), ("acknowledgementReference", _S),
            ("requestParameters", T.ArrayType(_struct(("paramName", _S), ("paramValue", _S)))),
        )),
        ("requestDetail", _struct(
            ("customerReference", _struct(("idType", _S), ("idValue", _S), ("ukResident", _B))),
            ("personalDetails", _struct(("firstName", _S), ("lastName", _S))),
            ("contactDetails", _struct(("emailAddress", _S))),
            ("declarationHeader", _struct(
                ("messageTypes", _struct(("messageType", _S))), ("chargeReference", _S),
                ("portOfEntry", _S), ("expectedDateOfArrival", _S), ("timeOfEntry", _S),
                ("travellingFrom", _S), ("onwardTravelGBNI", _S),
            )),
            ("declarationTobacco", _struct(
                ("totalExciseTobacco", _S), ("totalCustomsTobacco", _S), ("totalVATTobacco", _S),
                ("declarationItemTobacco", T.ArrayType(TOBACCO_ITEM)),
            )),
            ("declarationAlcohol", _struct(
                ("totalExciseAlcohol", _S), ("totalCustomsAlcohol", _S), ("totalVATAlcohol", _S),
                ("declarationItemAlcohol", T.ArrayType(ALCOHOL_ITEM)),
            )),
            ("declarationOther", _struct(
                ("totalExciseOther", _S), ("totalCustomsOther", _S), ("totalVATOther", _S),
                ("declarationItemOther", T.ArrayType(OTHER_ITEM)),
            )),
            ("liabilityDetails", _struct(
                ("totalExciseGBP", _S), ("totalCustomsGBP", _S), ("totalVATGBP", _S),
                ("grandTotalGBP", _S),
            )),
            ("amendmentLiabilityDetails", _struct(
                ("additionalExciseGBP", _S), ("additionalCustomsGBP", _S),
                ("additionalVATGBP", _S), ("additionalTotalGBP", _S),
            )),
        )),
    )),
)
