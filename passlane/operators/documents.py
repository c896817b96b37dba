"""Projections over nested declaration documents.

Documents are stored as JSON text. Each job parses a document once into a Variant
(``with_variant``) and navigates that (``try_variant_get``), so that JSON types stay
visible. All are narrow (per-row) projections: no shuffle, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passlane import schema as S
from passlane.operators.validate import validate_documents, with_variant

SDR = "$.simpleDeclarationRequest"
DETAIL = f"{SDR}.requestDetail"
HEADER = f"{DETAIL}.declarationHeader"
LIABILITY = f"{DETAIL}.liabilityDetails"

# Item arrays in receipt order: alcohol, then tobacco, then other.
ITEM_SECTIONS = (("declarationAlcohol", "declarationItemAlcohol", "alcohol"),
                 ("declarationTobacco", "declarationItemTobacco", "tobacco"),
                 ("declarationOther", "declarationItemOther", "other"))

# Default receipt copy addresses (a deployment passes its own).
DEFAULT_COPY_ADDRESSES = ("receipts-copy-1@example.com", "receipts-copy-2@example.com")


def jget(doc: Column, path: str, typ: str = "string") -> Column:
    """Field of a Variant document as ``typ`` (null when missing or not castable to it)."""
    return F.try_variant_get(doc, path, typ)


_JSON_TYPES = {"string": ("STRING",), "boolean": ("BOOLEAN",), "int": ("BIGINT",)}


def jstrict(doc: Column, path: str, typ: str) -> Column:
    """Field of a Variant document whose JSON type is ``typ`` itself; null otherwise.

    A number is no string and ``"true"`` is no boolean, as in the JSON reader being matched."""
    return F.when(F.schema_of_variant(F.try_variant_get(doc, path, "variant")).isin(*_JSON_TYPES[typ]),
                  F.try_variant_get(doc, path, typ))


# -- typed submission payload -----------------------------------------------------

def _typed_schema(dt: T.DataType, required: dict[str, list[str]], path: str = "") -> dict:
    """JSON Schema for the typed payload: types, and required fields of the model."""
    if isinstance(dt, T.StructType):
        props = {f.name: _typed_schema(f.dataType, required, f"{path}/{f.name}") for f in dt.fields}
        out = {"type": "object", "properties": props}
        if required.get(path):
            out["required"] = required[path]
        return out
    if isinstance(dt, T.ArrayType):
        return {"type": "array", "items": _typed_schema(dt.elementType, required, f"{path}/*")}
    if isinstance(dt, T.BooleanType):
        return {"type": "boolean"}
    return {"type": "string"}


# Non-optional fields of the typed payload (absent → the payload cannot be built).
PAYLOAD_REQUIRED = {
    "": ["simpleDeclarationRequest"],
    "/simpleDeclarationRequest": ["requestCommon", "requestDetail"],
    "/simpleDeclarationRequest/requestCommon": ["receiptDate", "acknowledgementReference",
                                                "requestParameters"],
    "/simpleDeclarationRequest/requestCommon/requestParameters/*": ["paramName", "paramValue"],
    "/simpleDeclarationRequest/requestDetail": ["customerReference", "contactDetails",
                                                "declarationHeader", "liabilityDetails"],
    "/simpleDeclarationRequest/requestDetail/customerReference": ["idType", "idValue", "ukResident"],
    "/simpleDeclarationRequest/requestDetail/personalDetails": ["firstName", "lastName"],
    "/simpleDeclarationRequest/requestDetail/declarationHeader": [
        "messageTypes", "chargeReference", "travellingFrom", "onwardTravelGBNI"],
    "/simpleDeclarationRequest/requestDetail/declarationHeader/messageTypes": ["messageType"],
    "/simpleDeclarationRequest/requestDetail/liabilityDetails": ["grandTotalGBP"],
}

PAYLOAD_SCHEMA = _typed_schema(S.PAYLOAD, PAYLOAD_REQUIRED)


def refine_payload(df: DataFrame, doc_col: str) -> DataFrame:
    """Adds ``payload`` (typed struct, unknown fields dropped, JSON via ``to_json``)
    and ``parse_ok``: false when a required field is missing or has another type."""
    checked = validate_documents(df.withColumn("__src", F.col(doc_col)), "__src", schema=PAYLOAD_SCHEMA)
    return (checked.withColumn("parse_ok", F.size("errors") == 0)
            .withColumn("payload", F.when(F.col("parse_ok"), F.try_variant_get("__doc", "$", S.PAYLOAD.simpleString())))
            .drop("errors", "__doc", "__parsed", "__src"))


def parse_failures(refined: DataFrame) -> DataFrame:
    return refined.where(~F.col("parse_ok"))


def payload_json(col: str = "payload") -> Column:
    """The refined payload as JSON text; missing optional fields are omitted."""
    return F.to_json(F.col(col))


# -- document choice -------------------------------------------------------------------

def amendment_or_original(df: DataFrame) -> DataFrame:
    """``chosen``: amend_data when an amendment exists (its absence is an error), else data."""
    has_amend = F.col("amend_state").isNotNull()
    return (df.withColumn("chosen", F.when(has_amend, F.col("amend_data")).otherwise(F.col("data")))
            .withColumn("chosen_source", F.when(has_amend & F.col("amend_data").isNull(), F.lit("error"))
                        .when(has_amend, F.lit("amendment")).otherwise(F.lit("original"))))


def pick_correlation(df: DataFrame, is_amendment: Column) -> Column:
    """Amendment correlation id for amendment submissions (null = error), else the original."""
    return F.when(is_amendment, F.col("amend_correlation_id")).otherwise(F.col("correlation_id"))


# -- items -------------------------------------------------------------------------------

ITEM_FIELDS = "struct<commodityDescription:string,goodsValueGBP:string,exciseGBP:string," \
              "customsGBP:string,vatGBP:string>"


def _tag(label: str):
    return lambda x: x.withField("category", F.lit(label))


def goods_items(df: DataFrame, doc_col: str = "data") -> DataFrame:
    """``items``: alcohol ++ tobacco ++ other item arrays (absent section → empty);
    ``items_json``: the same array as JSON text; ``items_error``: a section without
    its item array."""
    df = with_variant(df, doc_col, "__v")
    return _items(df, F.col("__v")).drop("__v")


def _items(df: DataFrame, doc: Column) -> DataFrame:
    parts, errors, texts = [], [], []
    for section, arr, label in ITEM_SECTIONS:
        sec = jget(doc, f"{DETAIL}.{section}", "variant")
        items = jget(doc, f"{DETAIL}.{section}.{arr}", f"array<{ITEM_FIELDS}>")
        tagged = F.transform(items, _tag(label))
        parts.append(F.coalesce(tagged, F.array().cast(f"array<{ITEM_FIELDS[:-1]},category:string>>")))
        errors.append(sec.isNotNull() & items.isNull())
        texts.append(F.coalesce(jget(doc, f"{DETAIL}.{section}.{arr}", "array<variant>"),
                                F.array().cast("array<variant>")))
    err = errors[0] | errors[1] | errors[2]
    return (df.withColumn("items", F.concat(*parts))
            .withColumn("items_json", F.to_json(F.concat(*texts)))
            .withColumn("items_error", err))


def explode_items(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """One row per item with its position in the concatenated list."""
    return df.select(*key_cols, F.posexplode("items").alias("pos", "item")).select(
        *key_cols, F.col("pos").cast("int").alias("pos"), "item.category",
        "item.commodityDescription", "item.goodsValueGBP", "item.exciseGBP", "item.vatGBP")


# -- receipts ------------------------------------------------------------------------------

def receipt_parameters(df: DataFrame, doc_col: str = "chosen") -> DataFrame:
    """The thirteen receipt parameters as columns, plus ``email`` and ``params`` (a map).

    ``receipt_error``: why no receipt can be made (null: it can): a section without its item
    array, or a date or time that is none."""
    doc = F.col("__v")
    df = _items(with_variant(df, doc_col, "__v"), doc)
    s = lambda path: F.coalesce(jget(doc, path), F.lit(""))
    receipt = s(f"{SDR}.requestCommon.receiptDate")
    arrival = s(f"{HEADER}.expectedDateOfArrival")
    time_ = s(f"{HEADER}.timeOfEntry")
    ref = s(f"{HEADER}.chargeReference")
    total = F.concat(F.lit("£"), s(f"{LIABILITY}.grandTotalGBP"))
    cols = {
        "subject": F.concat(F.when(F.lower(total) == "£0.00", F.lit(S.SUBJECT_ZERO))
                            .otherwise(F.lit(S.SUBJECT_NON_ZERO)), F.lit(" "), ref),
        "NAME": F.concat(s(f"{DETAIL}.personalDetails.firstName"), F.lit(" "),
                         s(f"{DETAIL}.personalDetails.lastName")),
        "DATE": F.when(receipt == "", F.lit("")).otherwise(
            F.date_format(F.call_function("try_to_date", F.substring(receipt, 1, 10), F.lit("yyyy-MM-dd")),
                          S.RECEIPT_DATE_FORMAT)),
        "PLACEOFARRIVAL": s(f"{HEADER}.portOfEntryName"),
        "DATEOFARRIVAL": F.when(arrival == "", F.lit("")).otherwise(
            F.date_format(F.call_function("try_to_date", arrival, F.lit("yyyy-MM-dd")), S.RECEIPT_DATE_FORMAT)),
        "TIMEOFARRIVAL": F.when(F.trim(time_) == "", time_).otherwise(
            F.upper(F.date_format(F.try_to_timestamp(time_, F.lit("HH:mm")), S.RECEIPT_TIME_FORMAT))),
        "REFERENCE": ref,
        "TOTAL": total,
        "TOTALEXCISEGBP": F.concat(F.lit("£"), s(f"{LIABILITY}.totalExciseGBP")),
        "TOTALCUSTOMSGBP": F.concat(F.lit("£"), s(f"{LIABILITY}.totalCustomsGBP")),
        "TOTALVATGBP": F.concat(F.lit("£"), s(f"{LIABILITY}.totalVATGBP")),
        "TRAVELLINGFROM": s(f"{HEADER}.travellingFrom"),
        "AllITEMS": F.col("items_json"),
    }
    out = df
    for k, c in cols.items():
        out = out.withColumn(k, c)
    params = F.create_map(*[x for k in S.RECEIPT_PARAMETER_KEYS for x in (F.lit(k), F.col(k))])
    return (out.withColumn("email", s(f"{DETAIL}.contactDetails.emailAddress"))
            .withColumn("params", params)
            .withColumn("receipt_error", F.when(F.col("items_error"), "items").when(F.col("DATE").isNull(), "receipt date")
                        .when(F.col("DATEOFARRIVAL").isNull(), "arrival date")
                        .when(F.col("TIMEOFARRIVAL").isNull(), "arrival time")).drop("__v"))


def receipt_recipients(params_df: DataFrame,
                       copy_addresses: tuple[str, str] = DEFAULT_COPY_ADDRESSES) -> DataFrame:
    """Receipt requests: one to the passenger when the address is non-empty, one to
    the two configured addresses always; fixed template, ``force`` = true."""
    request = F.struct(F.array(F.col("email")).alias("to"), F.lit("passenger").alias("kind"))
    copies = F.struct(F.array(*[F.lit(a) for a in copy_addresses]).alias("to"), F.lit("copy").alias("kind"))
    reqs = F.filter(F.array(request, copies), lambda r: (r["kind"] == "copy") | (F.col("email") != ""))
    return (params_df.select("*", F.explode(reqs).alias("r"))
            .select("*", F.col("r.to").alias("to"), F.col("r.kind").alias("recipient"),
                    F.lit(S.RECEIPT_TEMPLATE_ID).alias("templateId"), F.lit(True).alias("force"))
            .drop("r"))


def _receipts(df: DataFrame, disable_zero_pound: bool) -> DataFrame:
    """Receipt parameters of rows whose document exists and may need a receipt."""
    made = receipt_parameters(amendment_or_original(df).where(F.col("chosen_source") != "error"), "chosen")
    return made.where(F.lower("TOTAL") != "£0.00") if disable_zero_pound else made


def receipt_requests(df: DataFrame, disable_zero_pound: bool = False,
                     copy_addresses: tuple[str, str] = DEFAULT_COPY_ADDRESSES) -> DataFrame:
    """Whole receipt job for declarations: choose the document, drop zero-pound ones when
    the switch is on, build parameters and recipients; refused rows send nothing."""
    good = _receipts(df, disable_zero_pound).where(F.col("receipt_error").isNull())
    return receipt_recipients(good, copy_addresses)


def refused_receipts(df: DataFrame, disable_zero_pound: bool = False) -> DataFrame:
    """The rows for which no receipt can be made, with ``receipt_error``."""
    lost = amendment_or_original(df).where(F.col("chosen_source") == "error").select(
        "charge_reference", F.lit("amendment document").alias("receipt_error"))
    bad = _receipts(df, disable_zero_pound).where(F.col("receipt_error").isNotNull())
    return lost.unionByName(bad.select("charge_reference", "receipt_error"))


def triggered_receipts(triggers: DataFrame, declarations: DataFrame, disable_zero_pound: bool = False,
                       copy_addresses: tuple[str, str] = DEFAULT_COPY_ADDRESSES) -> DataFrame:
    """Receipt requests fired by payments: one set for each trigger (event_id, ref_value)."""
    fired = triggers.select("event_id", F.col("ref_value").alias("__ref"))
    rows = declarations.join(fired.select("__ref").distinct(), F.col("ref_value") == F.col("__ref"), "left_semi")
    made = receipt_requests(rows, disable_zero_pound, copy_addresses)
    return made.join(fired, F.col("ref_value") == F.col("__ref")).drop("__ref")


# -- audit, view, stamping -------------------------------------------------------------------

def audit_events(refined: DataFrame, app_name: str = "passlane",
                 journey_col: str = "journey_data") -> DataFrame:
    """Audit rows: the refined payload as detail plus ``isPrivateTravel`` when the journey
    data carries ``privateCraft``; constant type and transaction tag."""
    private = jstrict(F.col("__j"), "$.privateCraft", "boolean")
    # null when journey data has no flag; ``to_json`` then leaves the field out
    detail = F.col("payload").withField("isPrivateTravel", private)
    return with_variant(refined.where(F.col("parse_ok")), journey_col, "__j").select(
        *refined.columns,
        F.lit(app_name).alias("auditSource"),
        F.lit(S.AUDIT_TYPE).alias("auditType"),
        F.create_map(F.lit("transactionName"), F.lit(S.AUDIT_TRANSACTION_NAME)).alias("tags"),
        detail.alias("detail"),
    )


def previous_declaration_view(df: DataFrame) -> DataFrame:
    """The twelve-field view returned by a previous-declaration lookup, and ``view_error``: a
    member that the view cannot do without is missing or of another JSON type."""
    names, j, d = df.columns, F.col("__j"), F.col("__d")
    df = with_variant(with_variant(df, "journey_data", "__j"), "data", "__d")
    obj = lambda doc, path: jget(doc, path, "map<string,variant>").isNotNull()
    out = df.select(
        *names,
        jstrict(j, "$.euCountryCheck", "string").alias("euCountryCheck"),
        jstrict(j, "$.arrivingNICheck", "boolean").alias("arrivingNI"),
        jstrict(j, "$.ageOver17", "boolean").alias("isOver17"),
        jstrict(j, "$.isUKResident", "boolean").alias("isUKResident"),
        jstrict(j, "$.privateCraft", "boolean").alias("isPrivateTravel"),
        F.to_json(jget(j, "$.userInformation", "variant")).alias("userInformation"),
        F.to_json(jget(j, "$.calculatorResponse.calculation", "variant")).alias("calculation"),
        F.to_json(jget(d, LIABILITY, "variant")).alias("liabilityDetails"),
        F.to_json(jget(j, "$.purchasedProductInstances", "variant")).alias("oldPurchaseProductInstances"),
        jstrict(j, "$.amendmentCount", "int").alias("amendmentCount"),
        F.to_json(jget(j, "$.deltaCalculation", "variant")).alias("deltaCalculation"),
        F.coalesce(F.col("amend_state"), F.lit("None")).alias("amendState"),
        (obj(j, "$.userInformation") & obj(j, "$.calculatorResponse.calculation") & obj(d, LIABILITY)
         & jget(j, "$.purchasedProductInstances", "array<variant>").isNotNull()).alias("__whole"),
    )
    needed = ("euCountryCheck", "arrivingNI", "isOver17", "isPrivateTravel")
    missing = F.col(needed[0]).isNull()
    for c in needed[1:]:
        missing = missing | F.col(c).isNull()
    return out.withColumn("view_error", missing | ~F.col("__whole")).drop("__whole")


def stamp_reference(df: DataFrame, raw_col: str, reference_col: str) -> DataFrame:
    """``stamped``: the document with acknowledgementReference = ref + "0" and
    declarationHeader.chargeReference = ref (deep merge; missing parents created)."""
    from passlane.operators.validate import with_document
    return with_document(df, raw_col, reference_col, doc_col="__stamped") \
        .withColumn("stamped", F.to_json("__stamped")).drop("__stamped")


def split_journey(df: DataFrame, raw_col: str) -> DataFrame:
    """``journey_data`` (the journeyData member) and ``data`` (the document without it)."""
    return (with_variant(df, raw_col, "__v")
            .withColumn("journey_data", F.expr("to_json(try_variant_get(__v, '$.journeyData', 'variant'))"))
            .withColumn("data", F.expr("to_json(to_variant_object(map_filter(try_variant_get(__v, '$', "
                                       "'map<string,variant>'), (k, v) -> k != 'journeyData')))"))
            .drop("__v"))
