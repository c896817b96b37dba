"""DuckDB SQL for every registered query: the bridge formulas plus the expected result.

The CTEs below restate ``passlane.sources.bridge`` in SQL over the driver's views,
and each query's SQL restates the lifecycle rule directly on flat columns. JSON
text is never compared (key order differs between engines); documents are checked
through the flat values they carry.
"""

from __future__ import annotations

from passlane import schema as S

AS_OF_SQL = "TIMESTAMP '1998-01-01 00:00:00'"


def sql_encode(v: str) -> str:
    """The reference encoder in SQL (integer arithmetic, same as the Spark column)."""
    weights = S.REFERENCE_WEIGHTS[2:]
    fixed = sum(w * x for w, x in zip(S.REFERENCE_WEIGHTS[:2], S.REFERENCE_FIXED_VALUES))
    terms = " + ".join(f"{w} * ((({v}) // {10 ** (len(weights) - 1 - i)}) % 10)"
                       for i, w in enumerate(weights))
    return (f"('X' || substr('{S.CHECK_ALPHABET}', CAST(({fixed} + {terms}) % 23 AS INTEGER) + 1, 1)"
            f" || 'PR' || lpad(CAST({v} AS VARCHAR), 10, '0'))")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LINE_CTE = """
li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         l_discount, l_tax, l_shipdate,
         CAST(l_partkey % 3 AS INTEGER) AS cat,
         CAST(l_extendedprice AS DECIMAL(13,2)) AS goods,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(13,2)) * CAST(l_discount AS DECIMAL(4,2)), 2)
              AS DECIMAL(18,2)) AS excise,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(13,2)) * CAST(l_tax AS DECIMAL(4,2)), 2)
              AS DECIMAL(18,2)) AS vat
  FROM lineitem
),
tot AS (
  SELECT l_orderkey,
         SUM(excise) AS total_excise, SUM(vat) AS total_vat,
         SUM(CASE WHEN cat = 0 THEN excise END) AS excise_0,
         SUM(CASE WHEN cat = 1 THEN excise END) AS excise_1,
         SUM(CASE WHEN cat = 2 THEN excise END) AS excise_2,
         SUM(CASE WHEN cat = 0 THEN vat END) AS vat_0,
         SUM(CASE WHEN cat = 1 THEN vat END) AS vat_1,
         SUM(CASE WHEN cat = 2 THEN vat END) AS vat_2,
         COUNT(*) FILTER (WHERE cat = 0) AS n_0,
         COUNT(*) FILTER (WHERE cat = 1) AS n_1,
         COUNT(*) FILTER (WHERE cat = 2) AS n_2,
         COUNT(*) AS n_items
  FROM li GROUP BY l_orderkey
)"""

_LAST = "translate(split_part(c.c_name, '#', 2), '0123456789', 'abcdefghij')"

BASE_CTE = f"""
base0 AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_orderpriority, o.o_totalprice,
         c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal,
         CAST(o.o_orderkey + 1 AS INTEGER) AS ref_value,
         CAST(o.o_orderkey % 10 AS INTEGER) AS d,
         CAST((o.o_orderkey // 10) % 8 AS INTEGER) AS a,
         split_part(c.c_name, '#', 1) AS first_name,
         upper(substr({_LAST}, 1, 1)) || substr({_LAST}, 2) AS last_name,
         COALESCE(t.total_excise, 0) AS total_excise,
         COALESCE(t.total_vat, 0) AS total_vat,
         COALESCE(t.total_excise, 0) + COALESCE(t.total_vat, 0) AS grand_total,
         COALESCE(t.excise_0, 0) AS excise_0, COALESCE(t.excise_1, 0) AS excise_1,
         COALESCE(t.excise_2, 0) AS excise_2, COALESCE(t.vat_0, 0) AS vat_0,
         COALESCE(t.vat_1, 0) AS vat_1, COALESCE(t.vat_2, 0) AS vat_2,
         COALESCE(t.n_0, 0) AS n_0, COALESCE(t.n_1, 0) AS n_1, COALESCE(t.n_2, 0) AS n_2,
         COALESCE(t.n_items, 0) AS n_items
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN tot t ON t.l_orderkey = o.o_orderkey
),
base AS (
  SELECT *, {sql_encode('ref_value')} AS charge_reference,
         CASE WHEN c_custkey % 7 <> 0 THEN lower(last_name) || '@example.com' END AS email,
         'NAT' || CAST(c_nationkey AS VARCHAR) AS port,
         'Port of nation ' || CAST(c_nationkey AS VARCHAR) AS port_name,
         CASE WHEN o_orderkey % 11 <> 0
              THEN strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER), '%Y-%m-%d')
         END AS arrival_date,
         CASE WHEN o_orderkey % 13 <> 0
              THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':'
                   || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0')
         END AS arrival_time,
         CASE c_nationkey % 3 WHEN 0 THEN 'EU Only' WHEN 1 THEN 'NON_EU Only'
              ELSE 'Great Britain' END AS travelling_from,
         CASE c_nationkey % 3 WHEN 0 THEN 'euOnly' WHEN 1 THEN 'nonEuOnly'
              ELSE 'greatBritain' END AS eu_country_check,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS receipt_date
  FROM base0
)"""

DECL_CTE = """
decl0 AS (
  SELECT *,
         CASE WHEN d IN (0, 1) THEN 'pending-payment' WHEN d = 2 THEN 'payment-failed'
              WHEN d = 3 THEN 'payment-cancelled' WHEN d = 4 THEN 'submission-failed'
              ELSE 'paid' END AS state,
         CASE WHEN d < 5 THEN NULL WHEN a = 0 THEN 'pending-payment'
              WHEN a = 1 THEN 'payment-failed' WHEN a = 2 THEN 'payment-cancelled'
              WHEN a = 3 THEN 'submission-failed' WHEN a IN (4, 5) THEN 'paid'
              ELSE NULL END AS amend_state,
         d >= 6 AS sent_to_hod,
         'c-' || CAST(o_orderkey AS VARCHAR) AS correlation_id,
         CAST(o_orderdate AS TIMESTAMP) AS last_updated
  FROM base
),
decl AS (
  SELECT *,
         CASE WHEN amend_state IS NOT NULL THEN a = 5 END AS amend_sent_to_hod,
         CASE WHEN amend_state IS NOT NULL THEN 'a-' || CAST(o_orderkey AS VARCHAR) END
           AS amend_correlation_id
  FROM decl0
)"""

LOCKS_CTE = f"""
lck AS (
  SELECT ref_value AS lock_id,
         {AS_OF_SQL} - to_seconds(CAST(ref_value % 600 AS BIGINT)) AS last_updated,
         CASE WHEN ref_value % 26 <> 0
              THEN {AS_OF_SQL} - to_seconds(CAST(ref_value % 600 AS BIGINT)) END
           AS last_updated_date
  FROM decl WHERE ref_value % 13 = 0
),
live AS (
  SELECT * FROM lck
  WHERE last_updated_date IS NULL
     OR last_updated_date > {AS_OF_SQL} - INTERVAL 300 SECOND
)"""


NTF_CTE = f"""
ntf0 AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN user_id % 10 = 9 THEN 900000000 + user_id ELSE user_id * 7 + 1 END AS nref_value,
         CASE event_type WHEN 'purchase' THEN 'Successful' WHEN 'error' THEN 'Failed'
              WHEN 'click' THEN 'Cancelled' ELSE event_type END AS status
  FROM events
),
ntf AS (
  SELECT *, {sql_encode('nref_value')} AS reference,
         CASE WHEN event_id % 97 = 0 THEN lower({sql_encode('nref_value')})
              ELSE {sql_encode('nref_value')} END AS msg_reference,
         CASE WHEN event_id % 89 = 0 THEN NULL ELSE status END AS msg_status
  FROM ntf0
)"""


def sql_decode(r: str) -> str:
    digits = f"TRY_CAST(substr({r}, 5, 10) AS INTEGER)"
    return (f"CASE WHEN regexp_full_match({r}, 'X[A-Z]PR[0-9]{{10}}') AND {digits} IS NOT NULL "
            f"AND substr({r}, 2, 1) = substr({sql_encode(digits)}, 2, 1) THEN {digits} END")


E_RECEIPT = 'object has missing required properties (["receiptDate"])'
E_TOTAL = ('ECMA 262 regex "^-?[0-9]{1,11}[.][0-9]{1,2}$" does not match input string '
           '"12.345"')
E_HEADER = 'object instance has properties which are not allowed by the schema: ["unexpectedKey"]'
E_RESIDENT = ('instance type (string) does not match any allowed primitive type '
              '(allowed: ["boolean"])')

SUB_CTE = f"""
num AS (
  SELECT o_orderkey AS seq,
         CAST((SELECT max(o_orderkey) + 1 FROM orders) + row_number() OVER (ORDER BY o_orderkey)
              AS INTEGER) AS ref_value
  FROM orders WHERE o_orderkey % 31 <> 0
),
errs AS (
  SELECT seq, '/simpleDeclarationRequest/requestCommon' AS path, 'required' AS rule,
         {_q(E_RECEIPT)} AS message FROM num WHERE seq % 17 = 0
  UNION ALL
  SELECT seq, '/simpleDeclarationRequest/requestDetail/liabilityDetails/grandTotalGBP', 'pattern',
         {_q(E_TOTAL)} FROM num WHERE seq % 19 = 0
  UNION ALL
  SELECT seq, '/simpleDeclarationRequest/requestDetail/declarationHeader', 'additionalProperties',
         {_q(E_HEADER)} FROM num WHERE seq % 23 = 0
  UNION ALL
  SELECT seq, '/simpleDeclarationRequest/requestDetail/customerReference/ukResident', 'type',
         {_q(E_RESIDENT)} FROM num WHERE seq % 29 = 0
)"""


PAY_CTE = """
n AS (
  SELECT event_id, ts, msg_status AS status, nref_value AS ref_value FROM ntf
  WHERE event_id % 89 <> 0 AND event_id % 97 <> 0
),
kk AS (
  SELECT n.*, COALESCE(SUM(CASE WHEN status = 'Successful' THEN 1 ELSE 0 END) OVER (
           PARTITION BY ref_value ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
  FROM n
),
j AS (
  SELECT kk.*, d.state AS st, d.amend_state AS am, d.ref_value IS NOT NULL AS found,
         lv.lock_id IS NOT NULL AS locked
  FROM kk LEFT JOIN decl d ON d.ref_value = kk.ref_value
  LEFT JOIN live lv ON lv.lock_id = kk.ref_value
),
o1 AS (
  SELECT j.*,
         CASE WHEN st IN ('pending-payment', 'payment-cancelled', 'payment-failed') AND k = 0
              THEN 'declaration'
              WHEN st IN ('pending-payment', 'payment-cancelled', 'payment-failed', 'paid')
              THEN 'amendment' END AS lvl,
         CASE WHEN st IN ('pending-payment', 'payment-cancelled', 'payment-failed') THEN k - 1
              ELSE k END AS kl
  FROM j
),
o2 AS (
  SELECT o1.*,
         COALESCE(lvl = 'declaration' OR (lvl = 'amendment' AND am IS NOT NULL
                  AND am NOT IN ('paid', 'submission-failed') AND kl = 0), false) AS applies,
         CASE WHEN NOT found THEN 404 WHEN locked THEN 423 WHEN st = 'submission-failed' THEN 409
              WHEN lvl = 'amendment' AND am = 'submission-failed' THEN 409
              WHEN COALESCE(lvl = 'declaration' OR (lvl = 'amendment' AND am IS NOT NULL
                  AND am NOT IN ('paid', 'submission-failed') AND kl = 0), false)
                   AND status NOT IN ('Successful', 'Failed', 'Cancelled') THEN 500
              ELSE 202 END AS http_status
  FROM o1
),
o3 AS (
  SELECT o2.*, CASE WHEN found AND NOT locked THEN lvl END AS level,
         (http_status = 202 AND applies) AS applied
  FROM o2
)"""

BATCH_CTE = """
batch0 AS (
  SELECT d.*, false AS is_amendment, correlation_id AS correlation FROM decl d
  WHERE state = 'paid' AND NOT sent_to_hod
  UNION ALL
  SELECT d.*, true, amend_correlation_id FROM decl d
  WHERE state = 'paid' AND sent_to_hod AND amend_state = 'paid' AND amend_sent_to_hod = false
),
batch1 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY is_amendment ORDER BY ref_value) AS BIGINT) AS seq,
         CAST(row_number() OVER (PARTITION BY is_amendment ORDER BY ref_value) - 1 AS BIGINT) AS slot
  FROM batch0
),
batch AS (SELECT * FROM batch1 WHERE ref_value NOT IN (SELECT lock_id FROM live)),
resp AS (
  SELECT charge_reference, CASE WHEN ref_value % 4 < 2 THEN 204 WHEN ref_value % 4 = 2 THEN 400
         ELSE 503 END AS http_status, false AS is_amendment FROM decl WHERE state = 'paid'
  UNION ALL
  SELECT charge_reference, CASE WHEN ref_value % 4 < 2 THEN 204 WHEN ref_value % 4 = 2 THEN 400
         ELSE 503 END, true FROM decl WHERE state = 'paid' AND amend_state IS NOT NULL
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


DECL_WITH = with_ctes(LINE_CTE, BASE_CTE, DECL_CTE)
LOCK_WITH = with_ctes(LINE_CTE, BASE_CTE, DECL_CTE, LOCKS_CTE)

KEY_COLS = "charge_reference, ref_value, state, amend_state, sent_to_hod, amend_sent_to_hod, last_updated"

UNPAID = "state IN ('pending-payment', 'payment-cancelled', 'payment-failed')"
UNPAID_AMEND = ("state = 'paid' AND amend_state IN "
                "('pending-payment', 'payment-cancelled', 'payment-failed')")
PAID_FOR_SUB = "state = 'paid' AND NOT sent_to_hod"
AMEND_FOR_SUB = ("state = 'paid' AND sent_to_hod AND amend_state = 'paid' "
                 "AND amend_sent_to_hod = false")
DELETABLE = ("state = 'paid' AND sent_to_hod AND ((amend_state IS NULL AND amend_sent_to_hod IS NULL)"
             " OR (amend_state = 'paid' AND amend_sent_to_hod = true))")
STALE_TS = f"last_updated < {AS_OF_SQL} - INTERVAL 14 DAY"


def worklist(pred: str) -> str:
    return f"{DECL_WITH} SELECT {KEY_COLS} FROM decl WHERE {pred}"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_declarations"] = (
        f"{DECL_WITH} SELECT {KEY_COLS}, correlation_id, amend_correlation_id FROM decl")
    q["state_counts"] = (
        f"{DECL_WITH} SELECT state, CAST(COUNT(*) AS BIGINT) AS n FROM decl "
        "WHERE state IS NOT NULL GROUP BY state")
    q["status_summary"] = (
        f"{DECL_WITH} SELECT "
        "CAST(COUNT(*) FILTER (WHERE state = 'pending-payment') AS BIGINT) AS pending_payment, "
        "CAST(COUNT(*) FILTER (WHERE state = 'paid') AS BIGINT) AS payment_complete, "
        "CAST(COUNT(*) FILTER (WHERE state = 'payment-failed') AS BIGINT) AS payment_failed, "
        "CAST(COUNT(*) FILTER (WHERE state = 'payment-cancelled') AS BIGINT) AS payment_cancelled, "
        "CAST(COUNT(*) FILTER (WHERE state = 'submission-failed') AS BIGINT) AS failed_submission "
        "FROM decl")
    gauge_rows = " UNION ALL ".join(
        f"SELECT {_q(S.GAUGE_NAMES[s])} AS metric, "
        f"CAST(COUNT(*) FILTER (WHERE state = {_q(s)}) AS BIGINT) AS value FROM decl"
        for s in (S.PENDING_PAYMENT, S.PAID, S.PAYMENT_FAILED, S.PAYMENT_CANCELLED,
                  S.SUBMISSION_FAILED))
    q["status_gauges"] = f"{DECL_WITH} {gauge_rows}"
    q["unpaid_declarations"] = worklist(UNPAID)
    q["unpaid_amendments"] = worklist(UNPAID_AMEND)
    q["paid_for_submission"] = worklist(PAID_FOR_SUB)
    q["amendments_for_submission"] = worklist(AMEND_FOR_SUB)
    q["deletable_declarations"] = worklist(DELETABLE)
    q["failed_declarations"] = worklist("state = 'submission-failed'")
    q["failed_amendments"] = worklist("amend_state = 'submission-failed'")
    q["stale_declarations"] = worklist(f"{UNPAID} AND {STALE_TS}")
    q["stale_amendments"] = worklist(f"{UNPAID_AMEND} AND {STALE_TS}")
    q["retention_expired"] = worklist(
        f"{DELETABLE} AND strptime(receipt_date, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL 7200 MINUTE "
        f"< {AS_OF_SQL}")
    q["scan_locks"] = f"{LOCK_WITH} SELECT lock_id, last_updated, last_updated_date FROM lck"
    q["live_locks"] = f"{LOCK_WITH} SELECT lock_id, last_updated, last_updated_date FROM live"
    q["legacy_locks"] = (
        f"{LOCK_WITH} SELECT lock_id, last_updated, last_updated_date FROM lck "
        f"WHERE last_updated_date IS NULL AND last_updated < {AS_OF_SQL} - INTERVAL 300 SECOND")
    q["expire_locks"] = (
        f"{LOCK_WITH} SELECT lock_id, last_updated, last_updated_date FROM lck "
        f"WHERE NOT ((last_updated_date IS NOT NULL AND last_updated_date <= {AS_OF_SQL} - INTERVAL 300 SECOND)"
        f" OR (last_updated_date IS NULL AND last_updated < {AS_OF_SQL} - INTERVAL 300 SECOND))")
    q["exclude_locked"] = (
        f"{LOCK_WITH} SELECT {KEY_COLS} FROM decl WHERE {UNPAID} "
        "AND ref_value NOT IN (SELECT lock_id FROM live)")
    q["acquire_locks"] = (
        f"{LOCK_WITH} SELECT ref_value AS lock_id, {AS_OF_SQL} AS last_updated, "
        f"{AS_OF_SQL} AS last_updated_date FROM decl WHERE {PAID_FOR_SUB} "
        "AND ref_value NOT IN (SELECT lock_id FROM live)")
    q["release_locks"] = (
        f"{LOCK_WITH} SELECT lock_id, last_updated, last_updated_date FROM lck "
        "WHERE lock_id NOT IN (SELECT ref_value FROM decl WHERE state = 'submission-failed')")
    q["is_zero_pound"] = (
        f"{DECL_WITH} SELECT charge_reference, grand_total = 0 AS is_zero_pound FROM decl")
    q["encode_references"] = (
        f"SELECT CAST(o_orderkey + 1 AS INTEGER) AS ref_value, {sql_encode('o_orderkey + 1')} "
        "AS charge_reference FROM orders")
    q["validate_references"] = (
        f"WITH {NTF_CTE} SELECT event_id, msg_reference AS reference, "
        f"{sql_decode('msg_reference')} AS ref_value FROM ntf")
    q["intake_submissions"] = (
        "SELECT o_orderkey AS seq, 's-' || CAST(o_orderkey AS VARCHAR) AS correlation_id, "
        "o_orderkey % 31 <> 0 AS is_object FROM orders")
    sub = with_ctes(SUB_CTE)
    q["assign_references"] = (
        f"{sub} SELECT seq, ref_value, {sql_encode('ref_value')} AS charge_reference FROM num")
    q["validate_documents"] = f"{sub} SELECT seq, path, rule, message FROM errs"
    q["validation_summary"] = (
        f"{sub} SELECT path, rule, CAST(COUNT(*) AS BIGINT) AS n FROM errs GROUP BY path, rule")
    q["accept_submissions"] = (
        f"{sub} SELECT {sql_encode('ref_value')} AS charge_reference, ref_value, "
        "'pending-payment' AS state, false AS sent_to_hod, 's-' || CAST(seq AS VARCHAR) AS correlation_id, "
        f"{AS_OF_SQL} AS last_updated FROM num "
        "WHERE seq NOT IN (SELECT seq FROM errs) AND seq % 37 <> 0")
    q["rejected_submissions"] = (
        f"{sub}, firsts AS (SELECT seq, message, row_number() OVER "
        "(PARTITION BY seq ORDER BY path, rule, message) AS rn, COUNT(*) OVER (PARTITION BY seq) AS n "
        "FROM errs) "
        "SELECT o_orderkey AS seq, CAST(NULL AS INTEGER) AS ref_value, 'not_an_object' AS first_error, "
        "CAST(1 AS BIGINT) AS n_errors FROM orders WHERE o_orderkey % 31 = 0 "
        "UNION ALL SELECT f.seq, n.ref_value, f.message, CAST(f.n AS BIGINT) FROM firsts f "
        "JOIN num n ON n.seq = f.seq WHERE f.rn = 1 "
        "UNION ALL SELECT seq, ref_value, 'journeyData is missing or not an object', CAST(1 AS BIGINT) "
        "FROM num WHERE seq % 37 = 0 AND seq NOT IN (SELECT seq FROM errs)")
    amend_ok = ("o_orderkey % 35 <> 0 AND o_orderkey % 45 <> 0 AND o_orderkey % 53 <> 0 "
                "AND o_orderkey % 37 <> 0 AND ref_value NOT IN (SELECT lock_id FROM live)")
    q["accept_amendments"] = (
        f"{LOCK_WITH} SELECT charge_reference, ref_value, state, 'pending-payment' AS amend_state, "
        f"sent_to_hod, false AS amend_sent_to_hod, {AS_OF_SQL} AS last_updated, correlation_id, "
        "'m-' || CAST(o_orderkey AS VARCHAR) AS amend_correlation_id FROM decl WHERE " + amend_ok)
    q["amendment_outcomes"] = (
        f"{LOCK_WITH} SELECT o_orderkey AS seq, "
        "CASE WHEN o_orderkey % 45 = 0 THEN NULL WHEN o_orderkey % 35 = 0 "
        "THEN CAST(900000000 + o_orderkey AS INTEGER) ELSE ref_value END AS ref_value, "
        "CASE WHEN o_orderkey % 45 = 0 THEN 'missing_correlation_id' "
        "WHEN o_orderkey % 53 = 0 THEN 'invalid' WHEN o_orderkey % 35 = 0 THEN 'not_found' "
        "WHEN ref_value IN (SELECT lock_id FROM live) THEN 'locked' "
        "WHEN o_orderkey % 37 = 0 THEN 'no_journey_data' ELSE 'accepted' END AS outcome FROM decl")
    paid = f"{DECL_WITH} SELECT * FROM decl WHERE state = 'paid'"
    q["refine_payload"] = (
        f"{DECL_WITH} SELECT charge_reference, true AS parse_ok, 'DeclarationCreate' AS message_type, "
        "travelling_from, CAST(grand_total AS VARCHAR) AS grand_total_gbp, "
        f"CAST(n_items AS BIGINT) AS n_items, false AS has_port_name FROM decl WHERE {PAID_FOR_SUB}")
    q["parse_failures"] = f"{sub} SELECT seq, ref_value FROM num WHERE seq % 17 = 0 OR seq % 29 = 0"
    q["amendment_or_original"] = (
        f"{DECL_WITH} SELECT charge_reference, CASE WHEN amend_state IS NOT NULL THEN 'amendment' "
        "ELSE 'original' END AS chosen_source, CASE WHEN amend_state IS NOT NULL THEN "
        "'DeclarationAmend' ELSE 'DeclarationCreate' END AS message_type FROM decl")
    q["pick_correlation"] = (
        f"{DECL_WITH} SELECT charge_reference, false AS is_amendment, correlation_id AS correlation "
        f"FROM decl WHERE {PAID_FOR_SUB} UNION ALL SELECT charge_reference, true, amend_correlation_id "
        f"FROM decl WHERE {AMEND_FOR_SUB}")
    receipt = (
        f"concat(CASE WHEN grand_total = 0 THEN {_q(S.SUBJECT_ZERO)} ELSE {_q(S.SUBJECT_NON_ZERO)} END, "
        "' ', charge_reference) AS subject, first_name || ' ' || last_name AS NAME, "
        "strftime(o_orderdate, '%d %B %Y') AS DATE, port_name AS PLACEOFARRIVAL, "
        "CASE WHEN arrival_date IS NULL THEN '' ELSE strftime(CAST(arrival_date AS DATE), '%d %B %Y') "
        "END AS DATEOFARRIVAL, CASE WHEN arrival_time IS NULL THEN '' ELSE "
        "strftime(strptime(arrival_time, '%H:%M'), '%I:%M %p') END AS TIMEOFARRIVAL, "
        "charge_reference AS REFERENCE, '£' || CAST(grand_total AS VARCHAR) AS TOTAL, "
        "'£' || CAST(total_excise AS VARCHAR) AS TOTALEXCISEGBP, '£0.00' AS TOTALCUSTOMSGBP, "
        "'£' || CAST(total_vat AS VARCHAR) AS TOTALVATGBP, travelling_from AS TRAVELLINGFROM")
    q["receipt_parameters"] = (
        f"{DECL_WITH} SELECT charge_reference, {receipt}, CAST(n_items AS BIGINT) AS n_items "
        "FROM decl")
    copies = ",".join(("receipts-copy-1@example.com", "receipts-copy-2@example.com"))
    q["receipt_recipients"] = (
        f"{DECL_WITH} SELECT charge_reference, 'passenger' AS recipient, email AS to_text, "
        f"{_q(S.RECEIPT_TEMPLATE_ID)} AS templateId, true AS force FROM decl "
        "WHERE email IS NOT NULL UNION ALL "
        f"SELECT charge_reference, 'copy', {_q(copies)}, {_q(S.RECEIPT_TEMPLATE_ID)}, true "
        "FROM decl")
    subj = (f"concat(CASE WHEN grand_total = 0 THEN {_q(S.SUBJECT_ZERO)} ELSE {_q(S.SUBJECT_NON_ZERO)} "
            "END, ' ', charge_reference)")
    q["receipt_requests"] = (
        f"{DECL_WITH} SELECT charge_reference, 'passenger' AS recipient, {subj} AS subject FROM decl "
        "WHERE grand_total <> 0 AND email IS NOT NULL UNION ALL "
        f"SELECT charge_reference, 'copy', {subj} FROM decl WHERE grand_total <> 0")
    q["goods_items"] = (
        f"{DECL_WITH} SELECT d.charge_reference, CAST(row_number() OVER (PARTITION BY li.l_orderkey "
        "ORDER BY li.cat, li.l_linenumber, li.l_partkey, li.l_suppkey, li.l_extendedprice, li.l_quantity, "
        "li.l_discount, li.l_tax, li.l_shipdate) - 1 AS INTEGER) AS pos, "
        "CASE li.cat WHEN 0 THEN 'alcohol' WHEN 1 THEN 'tobacco' ELSE 'other' END AS category, "
        "'Part ' || CAST(li.l_partkey AS VARCHAR) AS commodityDescription, "
        "CAST(li.goods AS VARCHAR) AS goodsValueGBP, CAST(li.excise AS VARCHAR) AS exciseGBP, "
        "CAST(li.vat AS VARCHAR) AS vatGBP FROM li JOIN decl d ON d.o_orderkey = li.l_orderkey")
    q["concat_items"] = f"{DECL_WITH} SELECT charge_reference, CAST(n_items AS BIGINT) AS n_items FROM decl"
    q["audit_events"] = (
        f"{DECL_WITH} SELECT charge_reference, 'passlane' AS auditSource, "
        f"{_q(S.AUDIT_TYPE)} AS auditType, {_q(S.AUDIT_TRANSACTION_NAME)} AS transactionName, "
        "o_orderpriority = '1-URGENT' AS isPrivateTravel, charge_reference AS detail_reference "
        f"FROM decl WHERE {PAID_FOR_SUB}")
    q["previous_declaration_view"] = (
        f"{DECL_WITH} SELECT charge_reference, eu_country_check AS euCountryCheck, "
        "o_orderkey % 2 = 1 AS arrivingNI, c_acctbal >= 0 AS isOver17, c_nationkey = 23 AS isUKResident, "
        "o_orderpriority = '1-URGENT' AS isPrivateTravel, last_name AS user_last_name, "
        "CAST(grand_total AS VARCHAR) AS calc_all_tax, CAST(grand_total AS VARCHAR) AS liability_grand_total, "
        "CAST(n_items AS BIGINT) AS n_old_purchase, "
        "CASE WHEN amend_state IS NOT NULL THEN 1 END AS amendmentCount, "
        "CASE WHEN amend_state IS NOT NULL THEN CAST(grand_total AS VARCHAR) END AS delta_all_tax, "
        "coalesce(amend_state, 'None') AS amendState FROM decl WHERE state = 'paid'")
    q["stamp_reference"] = (
        f"{sub} SELECT seq, {sql_encode('ref_value')} || '0' AS ack_ref, "
        f"{sql_encode('ref_value')} AS doc_reference FROM num")
    q["split_journey"] = (
        f"{sub} SELECT seq, seq % 37 <> 0 AS has_journey, false AS data_has_journey FROM num")
    pay = with_ctes(LINE_CTE, BASE_CTE, DECL_CTE, LOCKS_CTE, NTF_CTE, PAY_CTE)
    q["intake_notifications"] = (
        f"WITH {NTF_CTE} SELECT event_id, msg_status AS status, "
        f"{sql_decode('msg_reference')} AS ref_value, CASE WHEN event_id % 89 = 0 THEN 'bad_shape' "
        "WHEN event_id % 97 = 0 THEN 'bad_reference' END AS reject_reason FROM ntf")
    q["notify_join"] = f"{pay} SELECT event_id, ref_value, found FROM j"
    q["point_lookup"] = (f"{pay} SELECT {KEY_COLS} FROM decl "
                         "WHERE ref_value IN (SELECT ref_value FROM n)")
    q["payment_outcomes"] = (
        f"{pay} SELECT event_id, ref_value, level, http_status, applied, "
        "CASE WHEN applied THEN CASE status WHEN 'Successful' THEN 'paid' WHEN 'Failed' THEN "
        "'payment-failed' WHEN 'Cancelled' THEN 'payment-cancelled' END END AS new_state FROM o3")
    q["receipt_triggers"] = (f"{pay} SELECT event_id, ref_value, level FROM o3 "
                             "WHERE applied AND status = 'Successful'")
    q["triggered_receipts"] = (
        f"{pay}, t AS (SELECT event_id, d.* FROM o3 JOIN decl d USING (ref_value) WHERE applied "
        "AND status = 'Successful') "
        f"SELECT event_id, charge_reference, 'passenger' AS recipient, {subj} AS subject FROM t "
        f"WHERE email IS NOT NULL UNION ALL SELECT event_id, charge_reference, 'copy', {subj} FROM t")
    q["apply_payments"] = (
        f"{pay}, fin0 AS (SELECT ref_value, level, status, row_number() OVER (PARTITION BY ref_value, "
        "level ORDER BY ts DESC, event_id DESC) AS rn, bool_or(status = 'Successful') OVER "
        "(PARTITION BY ref_value, level) AS any_s FROM o3 WHERE applied), "
        "fin AS (SELECT ref_value, level, CASE WHEN any_s THEN 'paid' WHEN status = 'Failed' "
        "THEN 'payment-failed' ELSE 'payment-cancelled' END AS fs FROM fin0 WHERE rn = 1) "
        "SELECT d.charge_reference, d.ref_value, coalesce(fd.fs, d.state) AS state, "
        "coalesce(fa.fs, d.amend_state) AS amend_state, d.sent_to_hod, d.amend_sent_to_hod, "
        f"{AS_OF_SQL} AS last_updated FROM decl d "
        "LEFT JOIN fin fd ON fd.ref_value = d.ref_value AND fd.level = 'declaration' "
        "LEFT JOIN fin fa ON fa.ref_value = d.ref_value AND fa.level = 'amendment' "
        "WHERE fd.fs IS NOT NULL OR fa.fs IS NOT NULL")
    bat = with_ctes(LINE_CTE, BASE_CTE, DECL_CTE, LOCKS_CTE, BATCH_CTE)
    q["submission_batch"] = (f"{bat} SELECT charge_reference, correlation, slot, true AS parse_ok "
                             "FROM batch WHERE NOT is_amendment")
    q["amendment_batch"] = (f"{bat} SELECT charge_reference, correlation, slot, true AS parse_ok "
                            "FROM batch WHERE is_amendment")
    q["quarantined"] = (f"{DECL_WITH} SELECT charge_reference, true AS is_amendment, "
                        "'missing document' AS quarantine_reason FROM decl WHERE amend_state IS NULL")
    q["quarantine_reasons"] = (
        f"{DECL_WITH}, w AS (SELECT charge_reference, ref_value % 6 AS k, false AS is_amendment FROM decl WHERE {PAID_FOR_SUB} "
        f"UNION ALL SELECT charge_reference, ref_value % 6, true FROM decl WHERE {AMEND_FOR_SUB}) "
        "SELECT charge_reference, is_amendment, k IN (0, 3) AS parse_ok, CASE k WHEN 4 THEN 'missing document' "
        "WHEN 3 THEN 'missing correlation id' WHEN 0 THEN NULL ELSE 'payload does not parse' END AS quarantine_reason FROM w")
    q["refused_receipts"] = (
        f"{DECL_WITH}, w AS (SELECT charge_reference, CASE ref_value % 7 "
        "WHEN 1 THEN 'receipt date' WHEN 2 THEN CASE WHEN arrival_date IS NOT NULL THEN 'arrival date' END "
        "WHEN 3 THEN CASE WHEN arrival_time IS NOT NULL THEN 'arrival time' END "
        "WHEN 4 THEN CASE WHEN amend_state IS NOT NULL THEN 'amendment document' END "
        "WHEN 5 THEN CASE WHEN n_0 > 0 THEN 'items' END END AS receipt_error FROM decl) "
        "SELECT charge_reference, receipt_error FROM w WHERE receipt_error IS NOT NULL")
    detail = "/simpleDeclarationRequest/requestDetail"
    keywords = [(0, f"{detail}/declarationHeader/timeOfEntry", "pattern", "o_orderkey % 13 <> 0"),
                (1, f"{detail}/declarationHeader/messageTypes/messageType", "enum", "true"),
                (2, f"{detail}/customerReference/idValue", "minLength", "true"),
                (3, f"{detail}/customerReference/idValue", "maxLength", "true"),
                (4, "/simpleDeclarationRequest/requestCommon/receiptDate", "format", "true"),
                (5, "/simpleDeclarationRequest/requestCommon/requestParameters/0", "required", "true"),
                (6, "", "maxProperties", "true"), (7, f"{detail}/liabilityDetails", "required", "true"),
                (7, f"{detail}/liabilityDetails", "minProperties", "true"),
                (8, f"{detail}/contactDetails/emailAddress", "type", "o_custkey % 7 <> 0"),
                (9, f"{detail}/declarationHeader", "additionalProperties", "true")]
    q["validation_keywords"] = " UNION ALL ".join(
        f"SELECT {_q(path)} AS path, {_q(rule)} AS rule, CAST(COUNT(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 10 = {k} "
        f"AND {when} AND " + " AND ".join(f"o_orderkey % {m} <> 0" for m in (17, 19, 23, 29, 31, 37)) for k, path, rule, when in keywords)
    q["dispatch_slots"] = (f"{bat} SELECT charge_reference, seq, slot FROM batch "
                           "WHERE NOT is_amendment")
    q["classify_responses"] = (
        f"{bat} SELECT charge_reference, is_amendment, http_status, CASE http_status WHEN 204 THEN "
        "'Submitted' WHEN 400 THEN 'Failed' ELSE 'Error' END AS result FROM resp")
    for name, amend, sent_col, state_col in (
            ("apply_submission_results", "false", "sent_to_hod", "state"),
            ("apply_amendment_results", "true", "amend_sent_to_hod", "amend_state")):
        res = ("CASE r.http_status WHEN 204 THEN 'Submitted' WHEN 400 THEN 'Failed' "
               "WHEN NULL THEN NULL ELSE 'Error' END")
        cols = []
        for c in KEY_COLS.split(", "):
            if c == sent_col:
                cols.append(f"CASE WHEN r.http_status = 204 THEN true ELSE b.{c} END AS {c}")
            elif c == state_col:
                cols.append(f"CASE WHEN r.http_status = 400 THEN 'submission-failed' ELSE b.{c} END AS {c}")
            elif c == "last_updated":
                cols.append(f"CASE WHEN r.http_status = 400 THEN {AS_OF_SQL} ELSE b.{c} END AS {c}")
            else:
                cols.append(f"b.{c}")
        q[name] = (
            f"{bat} SELECT {', '.join(cols)}, coalesce({res}, 'NoResponse') AS result FROM batch b "
            f"LEFT JOIN resp r ON r.charge_reference = b.charge_reference AND r.is_amendment = {amend} "
            f"WHERE b.is_amendment = {amend}")
    lk = LOCK_WITH
    unlocked = "ref_value NOT IN (SELECT lock_id FROM live)"
    q["requeue_failed"] = (
        f"{lk} SELECT charge_reference, ref_value, 'paid' AS state, amend_state, sent_to_hod, "
        f"amend_sent_to_hod, {AS_OF_SQL} AS last_updated FROM decl "
        f"WHERE state = 'submission-failed' AND {unlocked}")
    q["requeue_failed_amendments"] = (
        f"{lk} SELECT charge_reference, ref_value, state, 'paid' AS amend_state, sent_to_hod, "
        f"amend_sent_to_hod, {AS_OF_SQL} AS last_updated FROM decl "
        f"WHERE amend_state = 'submission-failed' AND {unlocked}")
    stamped = f"{AS_OF_SQL} AS last_updated, {AS_OF_SQL} AS last_updated_date"
    expired = (f"{DELETABLE} AND strptime(receipt_date, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL 7200 MINUTE "
               f"< {AS_OF_SQL}")
    q["held_locks"] = f"{lk} " + " UNION ALL ".join(
        f"SELECT {_q(job)} AS job, ref_value AS lock_id, {stamped} FROM decl WHERE {pred} AND {unlocked}"
        for job, pred in (
            ("remove_stale", f"{UNPAID} AND {STALE_TS}"), ("remove_stale_amendments", f"{UNPAID_AMEND} AND {STALE_TS}"),
            ("remove_expired", expired), ("requeue_failed", "state = 'submission-failed'"),
            ("requeue_failed_amendments", "amend_state = 'submission-failed'")))
    q["submitted_audit"] = (
        f"{bat} SELECT charge_reference, is_amendment, {_q(S.AUDIT_TYPE)} AS auditType, "
        "o_orderpriority = '1-URGENT' AS isPrivateTravel FROM batch WHERE ref_value % 4 < 2")
    q["remove_stale"] = f"{lk} SELECT {KEY_COLS} FROM decl WHERE {UNPAID} AND {STALE_TS} AND {unlocked}"
    q["remove_stale_amendments"] = (
        f"{lk} SELECT {KEY_COLS} FROM decl WHERE {UNPAID_AMEND} AND {STALE_TS} AND {unlocked}")
    q["remove_expired"] = (
        f"{lk} SELECT {KEY_COLS} FROM decl WHERE {DELETABLE} AND strptime(receipt_date, "
        f"'%Y-%m-%dT%H:%M:%SZ') + INTERVAL 7200 MINUTE < {AS_OF_SQL} AND {unlocked}")
    q["delete_rows"] = (
        f"{lk} SELECT {KEY_COLS} FROM decl WHERE NOT ({UNPAID} AND {STALE_TS} AND {unlocked})")
    amend_ok2 = ("o_orderkey % 35 <> 0 AND o_orderkey % 45 <> 0 AND o_orderkey % 53 <> 0 "
                 f"AND o_orderkey % 37 <> 0 AND {unlocked}")
    q["replace_row"] = (
        f"{lk} SELECT charge_reference, ref_value, state, "
        f"CASE WHEN {amend_ok2} THEN 'pending-payment' ELSE amend_state END AS amend_state, sent_to_hod, "
        f"CASE WHEN {amend_ok2} THEN false ELSE amend_sent_to_hod END AS amend_sent_to_hod, "
        f"CASE WHEN {amend_ok2} THEN {AS_OF_SQL} ELSE last_updated END AS last_updated, "
        f"CASE WHEN {amend_ok2} THEN 'm-' || CAST(o_orderkey AS VARCHAR) ELSE amend_correlation_id END "
        "AS amend_correlation_id FROM decl")
    q["insert_rows"] = (
        f"{with_ctes(LINE_CTE, BASE_CTE, DECL_CTE, SUB_CTE)} SELECT {KEY_COLS} FROM decl UNION ALL "
        f"SELECT {sql_encode('ref_value')}, ref_value, 'pending-payment', NULL, false, NULL, {AS_OF_SQL} "
        "FROM num WHERE seq NOT IN (SELECT seq FROM errs) AND seq % 37 <> 0")
    q["replaced_images"] = q["requeue_failed"]
    later = f"({AS_OF_SQL} + INTERVAL 120 DAY)"
    ticks = (
        f"{lk}, l0 AS (SELECT lock_id, min(last_updated) AS last_updated, min(last_updated_date) AS last_updated_date "
        f"FROM lck GROUP BY lock_id), "
        f"l1 AS (SELECT * FROM l0 WHERE last_updated_date IS NULL OR last_updated_date > {AS_OF_SQL} - INTERVAL 300 SECOND), "
        f"c1 AS (SELECT ref_value FROM decl WHERE {UNPAID} AND {STALE_TS} AND ref_value NOT IN (SELECT lock_id FROM l1)), "
        f"l2 AS (SELECT * FROM l1 WHERE last_updated_date IS NULL OR last_updated_date > {later} - INTERVAL 300 SECOND), "
        f"c2 AS (SELECT ref_value FROM decl WHERE {UNPAID} AND last_updated < {later} - INTERVAL 14 DAY "
        "AND ref_value NOT IN (SELECT ref_value FROM c1) AND ref_value NOT IN (SELECT lock_id FROM l2))")
    q["lock_table_after_ticks"] = (
        f"{ticks} SELECT lock_id, last_updated, last_updated_date FROM l2 WHERE NOT (last_updated_date IS NULL "
        f"AND last_updated < {later} - INTERVAL 300 SECOND) UNION ALL SELECT ref_value, {later}, {later} FROM c2")
    q["stream_dispatch"] = (
        f"{lk}, listed AS (SELECT *, row_number() OVER (ORDER BY ref_value) - 1 AS n FROM decl WHERE {PAID_FOR_SUB}) "
        f"SELECT charge_reference, correlation_id AS correlation, {AS_OF_SQL} + to_seconds(n // 10) AS send_at "
        f"FROM listed WHERE n // 10 <= 180 AND {unlocked}")
    q["amend_join"] = (
        f"{lk} SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 45 = 0 THEN NULL "
        "WHEN o_orderkey % 35 = 0 THEN CAST(900000000 + o_orderkey AS INTEGER) ELSE ref_value END "
        "AS ref_value, NOT (o_orderkey % 35 = 0 AND o_orderkey % 45 <> 0 AND o_orderkey % 53 <> 0) AS matched "
        "FROM decl")
    look = (f"{DECL_WITH}, req AS (SELECT o_orderkey AS request_id, last_name, ref_value AS asked, "
            "substr(charge_reference, 10, 5) AS tail, CASE WHEN (o_orderkey // 7) % 10 = 9 THEN 9 "
            "ELSE (o_orderkey // 7) % 5 END AS kind FROM base "
            "WHERE o_orderkey % 41 <> 0 AND o_orderkey % 43 <> 0 AND o_orderkey % 47 <> 0), "
            "el AS (SELECT * FROM decl WHERE state = 'paid' AND (amend_state IS NULL OR amend_state "
            "IN ('paid', 'pending-payment'))), "
            # a pattern with all ten digits matches its own reference alone
            "m AS (SELECT r.request_id, e.charge_reference FROM req r JOIN el e ON e.ref_value = r.asked "
            "WHERE kind NOT IN (2, 9) UNION ALL SELECT r.request_id, e.charge_reference FROM req r JOIN el e ON "
            "starts_with(CAST(e.ref_value AS VARCHAR), CAST(r.asked AS VARCHAR)) "
            "AND contains(lower(e.last_name), lower(r.last_name)) WHERE kind = 9 UNION ALL SELECT r.request_id, e.charge_reference FROM req r JOIN el e ON "
            "contains(e.charge_reference, r.tail) AND contains(lower(e.last_name), lower(r.last_name)) "
            "WHERE kind = 2), "
            "fm AS (SELECT request_id, min(charge_reference) AS charge_reference, "
            "CAST(COUNT(*) AS BIGINT) AS n_matches FROM m GROUP BY request_id)")
    q["intake_lookup_requests"] = (
        "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 41 = 0 OR o_orderkey % 43 = 0 THEN 'bad_shape' "
        "WHEN o_orderkey % 47 = 0 THEN 'bad_pattern' END AS reject_reason FROM orders")
    q["first_match"] = f"{look} SELECT request_id, charge_reference, n_matches FROM fm"
    q["previous_declaration_lookup"] = (
        f"{look} SELECT fm.request_id, fm.charge_reference, d.eu_country_check AS euCountryCheck, "
        "d.o_orderpriority = '1-URGENT' AS isPrivateTravel, coalesce(d.amend_state, 'None') AS amendState "
        "FROM fm JOIN decl d ON d.charge_reference = fm.charge_reference")
    q["stale_unlocked_receipts"] = (
        f"{LOCK_WITH} SELECT charge_reference, ref_value, state, last_updated, "
        f"CAST(grand_total AS VARCHAR) AS grand_total_gbp FROM decl WHERE {UNPAID} AND {STALE_TS} "
        "AND ref_value NOT IN (SELECT lock_id FROM live)")
    q["stream_payments"] = q["payment_outcomes"]
    q["stream_intake"] = q["accept_submissions"]
    q["stream_status"] = q["status_gauges"]
    q["periodic_source"] = q["unpaid_declarations"]
    q["stream_timeouts"] = q["remove_stale"]
    q["tap_output"] = q["remove_stale"]
    return q
