"""SQL for each registered query, written from the rules and not from the Spark plans."""

from __future__ import annotations

from workload.inputs import STATEMENT_SHAPES

_WS = r"E' \t\n\r\x0b\x0c'"

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTE[name] = (needs, body)


def with_ctes(*names: str, then: str) -> str:
    """``WITH`` the named tables and what they need, followed by ``then``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for need in CTE[name][0]:
                visit(need)
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in ordered) + "\n" + then


_cte("bronze", (), """
  SELECT b.k AS seq, b.base,
    concat('run-', CAST(b.k % 4 AS VARCHAR)) AS run_id,
    concat('raw/run_id=run-', CAST(b.k % 4 AS VARCHAR), '/doc-', CAST(b.fk AS VARCHAR),
           CASE b.base % 20 WHEN 0 THEN '.pdf' WHEN 1 THEN '.TIF' WHEN 19 THEN '.docx' ELSE '.png' END) AS source_s3_key,
    CASE b.base % 23 WHEN 1 THEN NULL WHEN 2 THEN '12345' WHEN 3 THEN 'X'
         WHEN 4 THEN concat('  "', c_name, '   Ltd" ') ELSE c_name END AS vendor_raw,
    CASE b.base % 11 WHEN 1 THEN NULL
         WHEN 2 THEN concat('$', price) WHEN 3 THEN replace(price, '.', ' ')
         WHEN 4 THEN concat('(', price, ')') WHEN 5 THEN concat('-', price)
         WHEN 6 THEN concat(price, ' USD') WHEN 7 THEN 'n/a' WHEN 8 THEN concat('9', price)
         ELSE price END AS amount_raw,
    CASE b.base % 13 WHEN 1 THEN NULL WHEN 2 THEN 'not a date' WHEN 3 THEN '2999-01-01' WHEN 4 THEN '1960-05-05'
         WHEN 5 THEN concat(CAST(month(odate) AS VARCHAR), '/', CAST(day(odate) AS VARCHAR), '/', CAST(year(odate) AS VARCHAR))
         ELSE CAST(odate AS VARCHAR) END AS date_raw,
    CASE b.base % 9 WHEN 1 THEN 'usd' WHEN 2 THEN ' PEN ' WHEN 3 THEN 'GBP' WHEN 4 THEN NULL WHEN 5 THEN NULL
         WHEN 6 THEN '' ELSE 'EUR' END AS currency_raw,
    concat(CASE b.base % 6 WHEN 4 THEN 'Memo' WHEN 5 THEN 'Contribution request' ELSE 'INVOICE' END,
           ' no ', CAST(b.base AS VARCHAR),
           CASE b.base % 9 WHEN 4 THEN ' total €' WHEN 5 THEN ' total $' ELSE '' END) AS raw_text,
    CASE WHEN b.k % 97 = 13 THEN 'failed' ELSE 'success' END AS ocr_status,
    CASE WHEN b.k % 41 <> 3 THEN concat(CAST(odate AS VARCHAR), 'T08:00:00Z') END AS created_at,
    (b.k % 113) / 8.0::DOUBLE AS duration_seconds
  FROM (SELECT o_orderkey AS k,
               CASE WHEN o_orderkey % 50 = 7 THEN o_orderkey - 7 WHEN o_orderkey % 50 = 9 THEN o_orderkey - 9
                    ELSE o_orderkey END AS base,
               CASE WHEN o_orderkey % 50 = 7 THEN o_orderkey - 7 ELSE o_orderkey END AS fk
        FROM orders) b
  JOIN (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price, CAST(o_orderdate AS DATE) AS odate
        FROM orders) o ON o.o_orderkey = b.base
  JOIN customer ON c_custkey = o.o_custkey""")


def clean(c: str) -> str:
    return (
        f"nullif(trim(regexp_replace(trim({c}, {_WS}), '\\s+', ' ', 'g'), E' ''\"\\t\\r\\n'), '')"
    )


def amount(c: str) -> str:
    spaced = "'([0-9][0-9,]*)\\s+([0-9]{2})([^0-9]|$)'"
    text = (
        f"CASE WHEN regexp_matches({c}, {spaced}) AND NOT contains({c}, '.') "
        f"THEN concat(regexp_extract({c}, {spaced}, 1), '.', regexp_extract({c}, {spaced}, 2)) ELSE {c} END"
    )
    bare = f"regexp_replace(regexp_replace(replace({text}, ',', ''), '[\\[\\](){{}}A-Za-z$]', '', 'g'), '\\s+', '', 'g')"
    return f"TRY_CAST(nullif(regexp_extract({bare}, '-?[0-9]+(\\.[0-9]+)?', 0), '') AS DOUBLE)"


def iso_date(c: str) -> str:
    return (
        f"CAST(CASE WHEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({c} AS DATE) "
        f"WHEN regexp_full_match({c}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') "
        f"THEN CAST(TRY_STRPTIME({c}, '%m/%d/%Y') AS DATE) END AS VARCHAR)"
    )


def doc_type(c: str) -> str:
    return (
        f"CASE WHEN contains(lower({c}), 'invoice') THEN 'invoice' "
        f"WHEN contains(lower({c}), 'contribution') THEN 'contribution' ELSE 'unknown' END"
    )


def currency(text: str, explicit: str, total: str) -> str:
    t = f"upper({text})"
    return (
        f"CASE WHEN trim(coalesce({explicit}, ''), {_WS}) <> '' THEN upper(trim({explicit}, {_WS})) "
        f"WHEN contains({t}, ' PEN') OR contains({t}, 'S/') OR contains({t}, 'SOLES') THEN 'PEN' "
        f"WHEN contains({t}, ' EUR') OR contains({text}, '€') THEN 'EUR' "
        f"WHEN {total} IS NOT NULL AND (contains({text}, '$') OR contains({t}, ' USD')) THEN 'USD' END"
    )


_cte("extracted", ("bronze",), """
  SELECT *, split_part(source_s3_key, '/', 3) AS source_file_name,
         split_part(split_part(source_s3_key, '/', 3), '.', 1) AS document_id
  FROM bronze""")


def rules(source: str, pre_flags: str) -> str:
    """The quality rules over columns failed, document_type, vendor_name, …"""
    return f"""
  SELECT *, CASE WHEN failed THEN 'failed' WHEN rejected THEN 'rejected' ELSE 'accepted' END AS processing_status,
    CASE WHEN failed OR rejected THEN 'rejected' WHEN len(flags) > 0 THEN 'warning' ELSE 'accepted' END AS quality_status,
    CASE WHEN failed THEN 0.0 WHEN rejected THEN least(0.4, greatest(0.0, 1.0 - 0.1 * least(len(flags), 8)))
         ELSE greatest(0.0, 1.0 - 0.1 * least(len(flags), 8)) END::DOUBLE AS quality_score,
    CASE WHEN failed THEN 'technical_processing_failure' WHEN NOT rejected THEN NULL
         WHEN bad_vendor THEN 'vendor_name_not_usable' WHEN bad_currency THEN 'currency_not_allowed'
         WHEN bad_amount THEN 'total_amount_exceeds_allowed_threshold'
         WHEN bad_date THEN 'document_date_out_of_allowed_range'
         WHEN no_created THEN 'missing_required_fields' ELSE 'minimum_acceptance_not_met' END AS rejection_reason,
    CASE WHEN failed THEN 'failed' WHEN rejected THEN 'rejected' ELSE 'valid' END AS outcome
  FROM (SELECT *, no_created OR nothing OR bad_date OR bad_amount OR bad_currency OR bad_vendor AS rejected,
      CASE WHEN failed THEN {pre_flags} ELSE list_concat({pre_flags}, list_filter([
        CASE WHEN no_created THEN 'missing_created_at' END,
        CASE WHEN nothing THEN 'minimum_acceptance_not_met' END,
        CASE WHEN bad_date THEN 'invalid_document_date' END,
        CASE WHEN document_date IS NULL AND NOT list_contains({pre_flags}, 'missing_document_date') THEN 'missing_document_date' END,
        CASE WHEN bad_amount THEN 'amount_outlier' END,
        CASE WHEN total_amount IS NULL THEN 'missing_total_amount' END,
        CASE WHEN total_amount IS NOT NULL AND currency IS NULL THEN 'currency_missing' END,
        CASE WHEN bad_currency THEN 'invalid_currency' END,
        CASE WHEN vendor_name IS NULL THEN 'vendor_missing' WHEN length(trim(vendor_name)) < 2 THEN 'vendor_too_short'
             WHEN bad_vendor THEN 'invalid_vendor' END,
        CASE WHEN document_type = 'unknown' THEN 'unknown_document_type' END
      ], lambda x: x IS NOT NULL)) END AS flags
    FROM (SELECT *, created_at IS NULL AS no_created,
        vendor_name IS NULL AND document_date IS NULL AND total_amount IS NULL AS nothing,
        coalesce(year(CAST(document_date AS DATE)) < 1970 OR CAST(document_date AS DATE) > DATE '2000-12-31', false) AS bad_date,
        coalesce(total_amount < 0 OR total_amount > 1000000, false) AS bad_amount,
        coalesce(currency NOT IN ('PEN', 'USD', 'EUR'), false) AS bad_currency,
        coalesce(length(trim(vendor_name)) >= 2 AND regexp_full_match(trim(vendor_name), '[0-9]+'), false) AS bad_vendor
      FROM {source}))"""


_cte("normal", ("extracted",), f"""
  SELECT seq, run_id, document_id, source_s3_key, source_file_name, created_at, duration_seconds, failed,
    CASE WHEN failed THEN 'unknown' ELSE kind END AS document_type,
    CASE WHEN NOT failed THEN vendor END AS vendor_name, CASE WHEN NOT failed THEN on_date END AS document_date,
    CASE WHEN NOT failed THEN total END AS total_amount,
    CASE WHEN NOT failed THEN {currency('raw_text', 'currency_raw', 'total')} END AS currency,
    CASE WHEN failed THEN ['textract_request_failed'] WHEN on_date IS NULL THEN ['missing_document_date']
         ELSE [] END AS pre_flags
  FROM (SELECT *, ocr_status = 'failed' AS failed, {clean('vendor_raw')} AS vendor, {iso_date('date_raw')} AS on_date,
               {amount('amount_raw')} AS total, {doc_type('raw_text')} AS kind FROM extracted)""")
_cte("silver", ("normal",), rules("normal", "pre_flags"))


def key_text(c: str) -> str:
    return f"regexp_replace(lower(trim({c}, {_WS})), '\\s+', ' ', 'g')"


_MONEY = "CAST(CAST(total_amount AS DECIMAL(38,2)) AS VARCHAR)"


def quoted(c: str) -> str:
    return f"coalesce('\"' || replace({c}, '\"', '\\\"') || '\"', 'null')"


_cte("eligible", ("silver",), f"""
  SELECT *,
    sha256('{{"currency":' || {quoted(key_text('currency'))} || ',"document_date":' || {quoted('document_date')}
      || ',"source_file_name":' || {quoted(key_text('source_file_name'))} || ',"total_amount":' || {quoted(_MONEY)}
      || ',"vendor_name":' || {quoted(key_text('vendor_name'))} || '}}') AS document_fingerprint,
    'invoice|' || {key_text('vendor_name')} || '|' || document_date || '|' || {_MONEY} || '|' || {key_text('currency')} AS business_key
  FROM silver WHERE processing_status = 'accepted' AND quality_status IN ('accepted', 'warning')""")


def marks(source: str, order: str) -> str:
    return f"""
  SELECT *, exact OR business AS is_duplicate,
    CASE WHEN exact THEN exact_of WHEN business THEN business_of END AS duplicate_of_document_id,
    CASE WHEN exact THEN 'exact_fingerprint' WHEN business THEN 'business_key' ELSE 'none' END AS duplicate_strategy,
    CASE WHEN exact THEN 1.0 WHEN business THEN 0.85 ELSE 0.0 END::DOUBLE AS duplicate_confidence
  FROM (SELECT *,
      row_number() OVER (PARTITION BY document_fingerprint ORDER BY {order}) > 1 AS exact,
      first_value(document_id) OVER (PARTITION BY document_fingerprint ORDER BY {order}) AS exact_of,
      business_key IS NOT NULL AND row_number() OVER (PARTITION BY business_key ORDER BY {order}) > 1 AS business,
      first_value(document_id) OVER (PARTITION BY business_key ORDER BY {order}) AS business_of
    FROM {source})"""


_cte("gold", ("eligible",), f"""
  SELECT *, 'batch-' || substr(created_at, 1, 7) AS batch_id FROM ({marks('eligible', 'seq')})""")
_cte("gold_run", ("eligible",), f"""
  SELECT * FROM ({marks('eligible', "run_id = 'run-3', seq")}) WHERE run_id = 'run-3'""")

_SUMMARY = """document_id AS invoice_id, document_date AS invoice_date, vendor_name AS supplier_name, currency,
  total_amount, CAST(NULL AS DECIMAL(18,2)) AS subtotal_amount, CAST(NULL AS DECIMAL(18,2)) AS tax_amount,
  document_type, created_at AS processing_date"""
_cte("summary", ("gold",), f"SELECT {_SUMMARY} FROM gold")
_cte("dedup", ("gold",), f"SELECT {_SUMMARY} FROM gold WHERE NOT is_duplicate")

_cte("candidates", ("extracted",), f"""
  SELECT seq, run_id, document_id, source_s3_key, source_file_name, created_at, ocr_status, duration_seconds,
    found, CASE WHEN found THEN 'invoice' ELSE 'unknown' END AS document_type,
    CASE WHEN found THEN 0.9::DOUBLE END AS type_confidence,
    CASE WHEN found AND vendor_raw <> '' THEN trim(vendor_raw, {_WS}) END AS vendor_name,
    CASE WHEN found THEN 99.5::DOUBLE END AS vendor_confidence,
    CASE WHEN found AND date_raw <> '' THEN trim(date_raw, {_WS}) END AS document_date,
    CASE WHEN found AND amount_raw <> '' THEN trim(amount_raw, {_WS}) END AS total_amount,
    CASE WHEN found THEN 97.75::DOUBLE END AS total_amount_confidence,
    CASE WHEN found AND currency_raw <> '' THEN trim(currency_raw, {_WS}) END AS currency,
    CASE WHEN found THEN raw_text END AS raw_text,
    CASE WHEN found THEN '' ELSE 'textract_no_expense_documents' END AS flags
  FROM (SELECT *, ocr_status = 'success' AND seq % 17 <> 5 AS found FROM extracted)""")

# Enrichment shapes: 0 and 4 full, 1 partial, 2 with an explicit null, 3 failed, 5 empty.
_cte("needed", ("candidates",), """
  SELECT *, document_type = 'unknown' OR vendor_name IS NULL OR document_date IS NULL OR currency IS NULL AS invoked,
    seq_fk % 6 AS shape
  FROM (SELECT *, seq AS seq_fk FROM candidates WHERE ocr_status = 'success')""")
_cte("merged", ("needed",), """
  SELECT seq, run_id, document_id, source_s3_key, source_file_name, created_at, raw_text, invoked, shape,
    CASE WHEN used AND shape IN (0, 4) THEN 'receipt' ELSE document_type END AS document_type,
    CASE WHEN used AND shape IN (0, 4) THEN concat('Vendor ', seq) WHEN used AND shape = 1 THEN concat('Partner ', seq)
         WHEN used AND shape = 2 THEN NULL ELSE vendor_name END AS vendor_name,
    CASE WHEN used AND shape IN (0, 4) THEN 0.8::DOUBLE WHEN used AND shape = 1 THEN 0.6 ELSE vendor_confidence END AS vendor_confidence,
    CASE WHEN used AND shape IN (0, 4) THEN '1999-05-05' WHEN used AND shape = 2 THEN '12/31/1998'
         ELSE document_date END AS document_date,
    CASE WHEN used AND shape IN (0, 4) THEN '150' WHEN used AND shape = 1 THEN '12.5' ELSE total_amount END AS total_amount,
    CASE WHEN used AND shape IN (0, 4) THEN 'PEN' WHEN used AND shape = 1 THEN 'EUR' WHEN used AND shape = 2 THEN 'USD'
         ELSE currency END AS currency,
    array_to_string(list_filter([
      CASE WHEN used AND currency IS NULL AND shape IN (0, 1, 2, 4) THEN 'currency' END,
      CASE WHEN used AND document_date IS NULL AND shape IN (0, 2, 4) THEN 'document_date' END,
      CASE WHEN used AND total_amount IS NULL AND shape IN (0, 1, 4) THEN 'total_amount' END,
      CASE WHEN used AND vendor_name IS NULL AND shape IN (0, 1, 4) THEN 'vendor_name' END], lambda x: x IS NOT NULL), ',') AS completed,
    concat_ws(',', nullif(flags, ''), CASE WHEN invoked AND shape = 3 THEN 'bedrock_request_failed' END) AS flags
  FROM (SELECT *, invoked AND shape <> 3 AS used FROM needed)""")
_cte("enriched_normal", ("merged",), f"""
  SELECT *, kind AS document_type, {currency("coalesce(raw_text, '')", 'cur', 'total_amount')} AS currency
  FROM (SELECT seq, created_at, raw_text, invoked, document_type AS kind, currency AS cur,
      contains(flags, 'bedrock_request_failed') AS failed,
      CASE WHEN flags = '' THEN []::VARCHAR[] ELSE string_split(flags, ',') END AS pre_flags,
      {clean('vendor_name')} AS vendor_name, {iso_date('document_date')} AS document_date, {amount('total_amount')} AS total_amount
    FROM merged)""")
_cte("enriched", ("enriched_normal",), rules("enriched_normal", "pre_flags"))
_cte("evidence_normal", ("candidates",), f"""
  SELECT *, {currency("coalesce(raw_text, '')", 'cur', 'total_amount')} AS currency
  FROM (SELECT source_s3_key, raw_text, document_type, currency AS cur, false AS failed, '2000-12-31T00:00:00Z' AS created_at,
      CASE WHEN flags = '' THEN []::VARCHAR[] ELSE [flags] END AS pre_flags,
      {clean('vendor_name')} AS vendor_name, {iso_date('document_date')} AS document_date,
      {amount('total_amount')} AS total_amount
    FROM candidates)""")
_cte("evidence_silver", ("evidence_normal",), rules("evidence_normal", "pre_flags"))

_cte("expected", (), """
  SELECT 'batch-' || CAST(k // 40 AS VARCHAR) AS batch_id, 'run-' || CAST(k % 4 AS VARCHAR) AS run_id,
         'doc-' || CAST(CASE WHEN k % 50 = 7 THEN k - 7 ELSE k END AS VARCHAR) AS document_id, k AS seq, false AS lost, NULL AS problem
  FROM (SELECT o_orderkey AS k FROM orders)
  UNION ALL
  SELECT 'batch-' || CAST(k // 40 AS VARCHAR), 'run-' || CAST(k % 4 AS VARCHAR), 'doc-lost-' || CAST(k AS VARCHAR), k, true, NULL
  FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 500 = 11
  UNION ALL
  SELECT 'batch-' || CAST(k // 40 AS VARCHAR), '', 'bad run', k, false, 'missing_run_id' FROM (SELECT o_orderkey AS k FROM orders)
  WHERE k % 500 <> 11 AND k % 800 = 33
  UNION ALL
  SELECT 'batch-' || CAST(k // 40 AS VARCHAR), 'run-' || CAST(k % 4 AS VARCHAR), '', k, false, 'missing_document_id'
  FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 500 <> 11 AND k % 800 <> 33 AND k % 900 = 67""")
_cte("matched", ("expected", "silver"), """
  SELECT e.*, s.outcome FROM expected e LEFT JOIN silver s ON s.run_id = e.run_id AND s.document_id = e.document_id""")
_cte("batches", ("matched",), """
  SELECT batch_id, count(*) AS expected_count, count(*) FILTER (outcome = 'valid') AS valid_count,
    count(*) FILTER (outcome = 'rejected') AS rejected_count, count(*) FILTER (outcome = 'failed') AS failed_count,
    count(*) FILTER (outcome IS NULL AND problem IS NULL) AS missing_count, count(problem) AS invalid_count,
    CASE WHEN count(problem) > 0 THEN 'invalid' WHEN count(*) FILTER (outcome IS NULL) > 0 THEN 'incomplete' ELSE 'completed' END AS status,
    array_to_string(list_sort(list(DISTINCT run_id) FILTER (problem IS NULL)), ',') AS run_ids
  FROM matched GROUP BY batch_id""")
_cte("batch_eligible", ("batches", "matched", "eligible"), """
  SELECT g.*, m.batch_id FROM eligible g
  JOIN matched m ON m.run_id = g.run_id AND m.document_id = g.document_id
  JOIN batches b ON b.batch_id = m.batch_id AND b.status = 'completed'""")
# Every batch's documents beside all other eligible documents: those of the past come first, whatever their number.
_cte("batch_gold", ("batch_eligible", "eligible"), f"""
  SELECT * FROM ({marks("""(SELECT *, false AS past FROM batch_eligible
      UNION ALL SELECT e.*, b.batch_id, true FROM eligible e JOIN (SELECT DISTINCT batch_id FROM batch_eligible) b
        ON EXISTS (SELECT 1 FROM batch_eligible m WHERE m.batch_id = b.batch_id AND m.seq <> e.seq
          AND (m.document_fingerprint = e.document_fingerprint OR m.business_key = e.business_key))
        AND NOT EXISTS (SELECT 1 FROM batch_eligible m WHERE m.batch_id = b.batch_id AND m.seq = e.seq))""", "past DESC, seq")
    .replace("PARTITION BY document_fingerprint", "PARTITION BY batch_id, document_fingerprint")
    .replace("PARTITION BY business_key", "PARTITION BY batch_id, business_key")}) WHERE NOT past""")

_cte("status_events", (), """
  SELECT 'doc-' || CAST(user_id AS VARCHAR) AS invoice_id, 'run-' || CAST(user_id % 4 AS VARCHAR) AS run_id,
    CASE event_type WHEN 'signup' THEN 'Uploaded' WHEN 'view' THEN 'Processing' WHEN 'click' THEN 'Consolidating'
         WHEN 'purchase' THEN 'Completed' ELSE 'Failed' END AS status,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS updated_at, event_id AS sequence, ts,
    CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS step
  FROM events""")
_cte("latest", ("status_events",), """
  SELECT invoice_id, run_id, status, updated_at, sequence FROM status_events
  QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY updated_at DESC, sequence DESC) = 1""")

_cte("attempts", (), """
  SELECT 'doc-' || CAST(user_id AS VARCHAR) AS document_id, event_id AS attempt, event_id % 9 AS shape, value,
    event_id % 9 IN (0, 3, 4) AS blocked
  FROM events""")

_cte("metrics", ("silver",), """
  SELECT run_id, unnest(list_filter(['DocumentsProcessed',
      CASE processing_status WHEN 'accepted' THEN 'DocumentsAccepted' WHEN 'rejected' THEN 'DocumentsRejected' ELSE 'DocumentsFailed' END,
      CASE WHEN vendor_name IS NOT NULL THEN 'VendorFieldPresent' END,
      CASE WHEN document_date IS NOT NULL THEN 'DateFieldPresent' END,
      CASE WHEN total_amount IS NOT NULL THEN 'AmountFieldPresent' END,
      CASE WHEN document_type = 'unknown' THEN 'UnknownDocumentType' END], lambda x: x IS NOT NULL)) AS metric_name
  FROM silver""")
_cte("run_summary", ("silver",), """
  SELECT run_id, count(*) AS documents_received, count(*) FILTER (outcome <> 'failed') AS documents_processed,
    count(*) FILTER (outcome = 'valid') AS documents_accepted, count(*) FILTER (outcome = 'rejected') AS documents_rejected,
    count(*) FILTER (outcome = 'failed') AS documents_failed, sum(duration_seconds) AS elapsed_seconds_total,
    avg(CASE WHEN total_amount IS NULL THEN 0 ELSE 1 END) FILTER (outcome = 'valid') AS amount_completion_rate,
    avg(CASE WHEN document_date IS NULL THEN 0 ELSE 1 END) FILTER (outcome = 'valid') AS date_completion_rate,
    avg(CASE WHEN vendor_name IS NULL THEN 0 ELSE 1 END) FILTER (outcome = 'valid') AS vendor_completion_rate,
    avg(CASE WHEN currency IS NULL THEN 0 ELSE 1 END) FILTER (outcome = 'valid') AS currency_completion_rate,
    avg(CASE WHEN document_type = 'unknown' THEN 1 ELSE 0 END) FILTER (outcome = 'valid') AS unknown_document_type_rate,
    0::BIGINT AS rejected_without_reason, 0::BIGINT AS critical_errors_in_gold,
    0.0::DOUBLE AS estimated_textract_cost, 0.0::DOUBLE AS estimated_bedrock_cost, 0.0::DOUBLE AS estimated_total_cost
  FROM silver GROUP BY run_id""")

_RATES = """round(count(total_amount) / count(*), 4) AS amount_completion_rate,
  round(count(document_date) / count(*), 4) AS date_completion_rate,
  round(count(vendor_name) / count(*), 4) AS vendor_completion_rate,
  round(count(currency) / count(*), 4) AS currency_completion_rate"""
_UNKNOWN = "round(count(*) FILTER (document_type = 'unknown') / count(*), 4) AS unknown_document_type_rate"


ORACLES: dict[str, str] = {
    "amount_normalize": with_ctes("bronze", then=f"SELECT seq, {amount('amount_raw')} AS amount FROM bronze"),
    "date_normalize": with_ctes("bronze", then=f"SELECT seq, {iso_date('date_raw')} AS document_date FROM bronze"),
    "date_formats": """
        SELECT o_orderkey AS seq,
          CASE WHEN o_orderkey % 14 IN (11, 12) THEN NULL WHEN o_orderkey % 14 = 13 THEN concat(CAST(year(o_orderdate) AS VARCHAR), '-12-31')
               ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS document_date
        FROM orders""",
    "vendor_clean": with_ctes("bronze", then=f"SELECT seq, {clean('vendor_raw')} AS vendor FROM bronze"),
    "text_repair": """
        SELECT c_custkey, CASE WHEN c_custkey % 13 = 12 THEN NULL ELSE
          concat(c_name, ' &', CASE c_custkey % 12 WHEN 0 THEN '''' WHEN 1 THEN '''' WHEN 2 THEN '"' WHEN 3 THEN '"'
            WHEN 6 THEN '''' WHEN 7 THEN '''' WHEN 8 THEN '"' WHEN 9 THEN '"' ELSE '' END, ' x') END AS repaired
        FROM customer""",
    "currency_infer": with_ctes("bronze", then=f"""
        SELECT seq, {currency('raw_text', 'currency_raw', 'total')} AS currency,
          CASE WHEN trim(coalesce(currency_raw, '')) <> '' THEN upper(trim(currency_raw))
               WHEN contains(raw_text, '€') THEN 'EUR' WHEN total IS NOT NULL AND contains(raw_text, '$') THEN 'USD' END AS strict_currency
        FROM (SELECT *, {amount('amount_raw')} AS total FROM bronze)"""),
    "key_parts": with_ctes("bronze", then="""
        SELECT seq, file_name, split_part(file_name, '.', 1) AS stem, lower('.' || split_part(file_name, '.', 2)) AS suffix,
          run_id, 'bronze/json/run_id=' || run_id || '/' || split_part(file_name, '.', 1) || '.json' AS bronze_key
        FROM (SELECT *, split_part(source_s3_key, '/', 3) AS file_name FROM bronze)"""),
    "url_parts": r"""
        SELECT page_id, name, CASE WHEN regexp_matches(name, '[^.]\.[^.]+$') THEN regexp_replace(name, '\.[^.]+$', '') ELSE name END AS stem,
          lower(regexp_extract(name, '[^.](\.[^.]+)$', 1)) AS suffix, CAST(NULL AS VARCHAR) AS run_id
        FROM (SELECT page_id, regexp_extract(rtrim(url, '/'), '[^/]*$') AS name FROM pages)""",
    "safe_names": r"""
        SELECT p_partkey,
          CASE WHEN p_partkey % 29 IN (1, 2) THEN 'unknown_document' ELSE
            trim(regexp_replace(concat('._', p_name, '@/', p_brand, '._'), '[^A-Za-z0-9_.-]+', '_', 'g'), '._') END AS safe_stem,
          substr(regexp_replace(concat('run/7-', p_name, ' #', p_partkey, '.v1-', p_partkey % 3), '[^A-Za-z0-9_-]', '-', 'g'), 1, 80) AS execution_name,
          concat(p_type, '-20001231T102030Z') AS run_id
        FROM part""",
    "collision_names": with_ctes("bronze", then="""
        SELECT path, CASE WHEN copy = 0 THEN file_name ELSE split_part(file_name, '.', 1) || '_' || copy || '.' || split_part(file_name, '.', 2) END AS target_name
        FROM (SELECT source_s3_key AS path, split_part(source_s3_key, '/', 3) AS file_name,
                row_number() OVER (PARTITION BY split_part(source_s3_key, '/', 3) ORDER BY source_s3_key) - 1 AS copy FROM bronze)"""),
    "text_clean_lines": r"""
        SELECT doc_id, md5(clean) AS text_md5, length(clean) AS n_chars_clean
        FROM (SELECT doc_id, array_to_string(list_filter(list_transform(
            regexp_split_to_array(concat(E' \r\n', replace(text, '. ', E'.  \n\t \n '), E'\n '), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'),
            lambda x: regexp_replace(regexp_replace(x, '^[\s\x1f\x{a0}\p{Z}]+', ''), '[\s\x1f\x{a0}\p{Z}]+$', '')), lambda x: x <> ''), E'\n') AS clean FROM documents)""",
    "doc_type_classify": with_ctes("bronze", then=f"SELECT seq, {doc_type('raw_text')} AS document_type FROM bronze"),
    "text_fingerprint": """
        SELECT CAST(doc_id AS VARCHAR) AS document_id, fp AS document_fingerprint,
          row_number() OVER w > 1 AS is_duplicate,
          CASE WHEN row_number() OVER w > 1 THEN CAST(first_value(doc_id) OVER w AS VARCHAR) END AS duplicate_of_document_id
        FROM (SELECT doc_id, sha256(text) AS fp FROM documents) WINDOW w AS (PARTITION BY fp ORDER BY doc_id)""",
    "markdown_round_trip": r"""
        SELECT doc_id, CASE WHEN bare THEN 'unknown.tif' ELSE name END AS file_name,
          CASE WHEN bare THEN 'unknown.tif' ELSE 'data/raw/' || name END AS path, length(md) AS n_chars, md5(md) AS markdown_md5
        FROM (SELECT *, CASE WHEN bare THEN text ELSE concat(E'# OCR Extract\n\n- Source file: `', name, E'`\n- Source path: `data/raw/', name,
                E'`\n\n## OCR Text\n\n```text\n', text, E'\n```\n') END AS md
              FROM (SELECT doc_id, text, n_chars % 3 = 0 AS bare, concat('doc-', doc_id, '.tif') AS name FROM documents))""",
    "input_validation": with_ctes("bronze", then="""
        SELECT seq, errors = '' AS valid, errors FROM (
          SELECT seq, concat_ws(',', CASE WHEN seq % 37 IN (1, 2) THEN 'missing_run_id' END,
            CASE WHEN seq % 31 = 3 THEN 'missing_source_s3_key' END,
            CASE WHEN seq % 29 <> 4 AND (seq % 31 = 3 OR source_s3_key LIKE '%.docx') THEN 'unsupported_extension' END) AS errors
          FROM bronze)"""),
    "upload_validation": """
        WITH f AS (
          SELECT CASE WHEN (k // 120) % 3 = 1 THEN 'w-' || (k // 12) ELSE 'n-' || (k // 6) END AS request_id, k,
            CASE WHEN k % 17 IN (3, 4) THEN 'unsupported_file_type: only PDF and TIFF invoice files are accepted.'
                 WHEN k % 19 = 2 THEN 'unsupported_file_type: unsupported content_type for invoice upload.'
                 WHEN p_size * 430000 > 20971520 THEN 'invalid_request: file size exceeds 20 MB limit.' END AS err
          FROM (SELECT p_partkey AS k, p_size FROM part)),
        r AS (SELECT request_id, count(*) AS file_count,
                CASE WHEN count(*) > 10 THEN 'invalid_request: Maximum 10 files per request.'
                     ELSE min_by(err, k) FILTER (err IS NOT NULL) END AS e FROM f GROUP BY request_id)
        SELECT request_id, file_count, e IS NULL AS accepted, split_part(e, ': ', 1) AS error, split_part(e, ': ', 2) AS message FROM r""",
    "arrival_unwrap": with_ctes("bronze", then=r"""
        , o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS arrived, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS stamp,
                  source_s3_key AS key, run_id AS run, concat('raw/no run/', o_orderkey, ' año+100%.pdf') AS spaced
                FROM orders JOIN bronze ON seq = o_orderkey),
        r AS (
          SELECT k, 0 AS i, 'lake' AS bucket, key AS skey, CASE WHEN k % 10 = 0 THEN 'direct' ELSE run END AS run_id,
                 CASE WHEN k % 10 IN (0, 4) THEN '' ELSE 'm-' || k END AS mid, arrived FROM o WHERE k % 10 NOT IN (1, 5)
          UNION ALL SELECT k, 0, 'lake', '', 'late-' || stamp, '', arrived FROM o WHERE k % 10 = 1
          UNION ALL SELECT k, 0, 'lake', spaced, 'late-' || stamp, 'm-' || k, arrived FROM o WHERE k % 10 = 5
          UNION ALL SELECT k, 1, 'lake', spaced, 'late-' || stamp, 'm-' || k, arrived FROM o WHERE k % 10 = 2)
        SELECT k AS event_id, i AS record_index, bucket AS bucket_name, skey AS source_s3_key,
          regexp_extract(skey, '[^/]*$') AS source_file_name, run_id, mid AS message_id, arrived AS created_at,
          substr(regexp_replace(concat(run_id, '-', regexp_replace(regexp_extract(skey, '[^/]*$'), '\.[^.]+$', ''), '-', i), '[^\p{L}\p{N}_-]', '-', 'g'), 1, 80) AS execution_id
        FROM r"""),
    "arrival_quarantine": """
        SELECT o_orderkey AS event_id, 'm-' || o_orderkey AS message_id, '{broken' AS body, 'invalid_sqs_body' AS error
        FROM orders WHERE o_orderkey % 10 = 1""",
    "raw_listing": with_ctes("bronze", then="""
        SELECT source_s3_key AS path, length(raw_text) AS length FROM bronze WHERE source_s3_key NOT LIKE '%.docx'"""),
    "silver_documents": with_ctes("silver", then="""
        SELECT seq, run_id, document_id, source_s3_key, source_file_name, 'bronze/' || document_id || '.md' AS raw_text_path,
          document_type, vendor_name, document_date, total_amount, currency, 'local_tesseract' AS extraction_engine,
          false AS enrichment_invoked, processing_status, quality_status, round(quality_score, 4) AS quality_score,
          array_to_string(flags, ',') AS quality_flags, rejection_reason, rejection_reason AS reason_code, false AS is_duplicate,
          'none' AS duplicate_strategy, created_at, vendor_name AS vendor_or_requester, source_file_name AS source_file,
          array_to_string(flags, ',') AS ocr_confidence_flags
        FROM silver"""),
    "quality_flags": with_ctes("silver", then="SELECT seq, array_to_string(flags, ',') AS flags FROM silver"),
    "rejection_reason": with_ctes("silver", then="""
        SELECT rejection_reason, quality_status, count(*) AS documents, round(avg(quality_score), 4) AS avg_score FROM silver GROUP BY 1, 2"""),
    "outcome_routing": with_ctes("silver", then="""
        SELECT seq, outcome, CASE outcome WHEN 'failed' THEN 'errors/silver_failed' WHEN 'rejected' THEN 'silver/rejected' ELSE 'silver/valid' END
          || '/run_id=' || run_id || '/' || document_id || '.json' AS output_key FROM silver"""),
    "rerun_outcomes": with_ctes("silver", then="""
        SELECT seq, outcome, delivery FROM (
          SELECT seq, run_id, document_id, CASE WHEN seq % 2 = 0 THEN 'failed' ELSE outcome END AS outcome, 1::BIGINT AS delivery FROM silver
          UNION ALL SELECT seq, run_id, document_id, outcome, 2::BIGINT FROM silver WHERE seq % 2 = 0)
        QUALIFY delivery = max(delivery) OVER (PARTITION BY run_id, document_id)"""),
    "failed_documents": with_ctes("silver", then="""
        SELECT seq, document_type, vendor_name, total_amount, quality_score, rejection_reason, array_to_string(flags, ',') AS flags
        FROM silver WHERE failed"""),
    "candidate_extract": with_ctes("candidates", then="""
        SELECT seq, document_type, type_confidence, vendor_name, vendor_confidence, document_date, total_amount,
          total_amount_confidence, currency, raw_text, flags FROM candidates"""),
    "evidence_silver": with_ctes("evidence_silver", then="""
        SELECT source_s3_key, document_type, vendor_name, document_date, total_amount, currency, 'glue_normalize' AS normalization_engine,
          processing_status, rejection_reason, array_to_string(flags, ',') AS flags FROM evidence_silver"""),
    "response_parse": with_ctes("attempts", then="""
        SELECT attempt, CASE shape WHEN 0 THEN 'empty_llm_response' WHEN 3 THEN 'invalid_json_response' WHEN 4 THEN 'invalid_json_response'
            WHEN 6 THEN 'low_contrast' WHEN 7 THEN 'a,b' WHEN 8 THEN 'invalid_ocr_confidence_flags' ELSE '' END AS flags,
          CASE shape WHEN 1 THEN round(value, 4) WHEN 2 THEN 1200.0 WHEN 5 THEN 12.0 WHEN 7 THEN 750.0 WHEN 8 THEN 5.0 END::DOUBLE AS total_amount,
          CASE shape WHEN 1 THEN '2024-01-05' END AS document_date, CASE shape WHEN 1 THEN 'Acme' WHEN 2 THEN 'Beta' END AS vendor_name
        FROM attempts"""),
    "best_attempt": with_ctes("attempts", then="""
        , r AS (SELECT *, CASE shape WHEN 0 THEN '' WHEN 3 THEN 'no braces here' WHEN 4 THEN '{"total_amount": 12, "vendor_name": "Cut'
              WHEN 1 THEN concat(E'Here you go:\\n```json\\n{"total_amount": "$', value, E'", "document_date": "2024-01-05", "vendor_name": "Acme"}\\n```\\nBye')
              WHEN 2 THEN 'Sure: {"total_amount": 1.2e3, "document_date": null, "vendor_name": "Beta"} and more {text'
              WHEN 5 THEN '[{"total_amount": 12}]' WHEN 6 THEN '{"total_amount": null, "ocr_confidence_flags": "low_contrast"}'
              WHEN 7 THEN '{"total_amount": "7,50", "ocr_confidence_flags": ["a", "b"]}'
              ELSE '{"total_amount": 5, "ocr_confidence_flags": {"x": 1}}' END AS response FROM attempts)
        SELECT document_id, coalesce(min(attempt) FILTER (NOT blocked), max(attempt)) AS attempt,
          CASE WHEN count(*) FILTER (NOT blocked) > 0 THEN min_by(response, attempt) FILTER (NOT blocked) ELSE max_by(response, attempt) END AS response,
          count(*) AS attempts, count(*) FILTER (NOT blocked) = 0 AS exhausted FROM r GROUP BY document_id"""),
    "enrichment_needed": with_ctes("needed", then="SELECT seq, flags FROM needed WHERE invoked"),
    "enrichment_merge": with_ctes("merged", then=f"""
        SELECT seq, document_type, vendor_name, vendor_confidence, document_date, round({amount('total_amount')}, 4) AS total_amount,
          currency, invoked AS enrichment_invoked, completed, flags FROM merged"""),
    "enriched_silver": with_ctes("enriched", then="""
        SELECT CASE WHEN invoked THEN 'bedrock' ELSE 'textract_only' END AS normalization_engine, processing_status, rejection_reason,
          count(*) AS documents, count(vendor_name) AS vendors, count(document_date) AS dates, round(sum(total_amount), 2) AS total
        FROM enriched GROUP BY 1, 2, 3"""),
    "candidate_reuse": with_ctes("candidates", then="""
        SELECT seq, ocr_status = 'failed' AS failed, vendor_name, document_date, total_amount, currency,
          CASE WHEN ocr_status = 'failed' THEN 'textract_request_failed' ELSE flags END AS flags FROM candidates"""),
    "legacy_contract": with_ctes("extracted", then=f"""
        SELECT concat('s', seq, '.md') AS source_file, kind AS document_type, concat('s', seq) AS document_id, on_date AS document_date,
          vendor AS vendor_or_requester, total AS amount, total AS total_amount,
          CASE WHEN contains(raw_text, '$') OR total IS NOT NULL THEN 'USD' END AS currency, 'bronze/' || document_id || '.md' AS raw_text_path,
          concat_ws(',', CASE WHEN ocr_status = 'failed' THEN 'textract_request_failed' END,
            CASE WHEN amount_raw <> '' AND total IS NULL THEN 'invalid_total_amount' END,
            CASE WHEN date_raw <> '' AND on_date IS NULL THEN 'invalid_document_date' END,
            CASE WHEN total IS NULL THEN 'missing_total_amount' END, CASE WHEN on_date IS NULL THEN 'missing_document_date' END,
            CASE WHEN vendor IS NULL THEN 'missing_vendor_or_requester' END,
            CASE WHEN kind = 'unknown' THEN 'unknown_document_type' END) AS ocr_confidence_flags,
          """ + ", ".join(
              f"CAST(NULL AS {t}) AS {n}" for t, names in {
                  "VARCHAR": "recipient_name recipient_address description account_code check_payable_to payment_terms notes "
                             "invoice_number customer_name project_name job_number line_items_text current_office_district "
                             "aspired_office_district party leadership_position approved_by",
                  "DOUBLE": "tax_amount subtotal_amount amount_due", "BOOLEAN": "state_flag local_flag",
              }.items() for n in names.split()) + f"""
        FROM (SELECT *, {amount('amount_raw')} AS total, {iso_date('date_raw')} AS on_date, {clean('vendor_raw')} AS vendor,
                {doc_type('raw_text')} AS kind FROM extracted)"""),
    "gold_documents": with_ctes("gold", then="""
        SELECT seq, run_id, document_id, document_type, document_date, vendor_name, total_amount, currency, processing_status,
          quality_status, array_to_string(flags, ',') AS quality_flags, rejection_reason, created_at, document_fingerprint,
          business_key, is_duplicate, duplicate_of_document_id, duplicate_strategy, duplicate_confidence, batch_id FROM gold"""),
    "duplicate_marks": with_ctes("gold", then="""
        SELECT seq, is_duplicate, duplicate_of_document_id, duplicate_strategy, duplicate_confidence FROM gold"""),
    "gold_incremental": with_ctes("gold_run", then="""
        SELECT seq, is_duplicate, duplicate_of_document_id, duplicate_strategy, duplicate_confidence FROM gold_run"""),
    "gold_run": with_ctes("gold_run", then="""
        SELECT seq, is_duplicate, duplicate_of_document_id, duplicate_strategy, duplicate_confidence FROM gold_run"""),
    "invoice_summary": with_ctes("summary", then="SELECT * FROM summary"),
    "invoice_summary_dedup": with_ctes("dedup", then="SELECT * FROM dedup"),
    "invoice_summary_typed": with_ctes("summary", then="""
        SELECT invoice_id, CAST(CAST(invoice_date AS DATE) AS VARCHAR) AS invoice_date,
          CAST(CAST(total_amount AS DECIMAL(18,2)) AS VARCHAR) AS total_amount, substr(processing_date, 1, 10) || ' 08:00' AS processing_date
        FROM summary"""),
    "gold_partition_scan": with_ctes("gold", then="""
        SELECT batch_id, count(*) AS documents, count(*) FILTER (is_duplicate) AS duplicates, round(sum(total_amount), 2) AS total,
          CAST(sum(len(flags)) AS BIGINT) AS flags FROM gold GROUP BY batch_id"""),
    "silver_json_scan": with_ctes("silver", then="""
        SELECT run_id, processing_status, quality_status, count(*) AS documents, count(vendor_name) AS vendors,
          CAST(sum(len(flags)) AS BIGINT) AS flags, min(source_file_name) AS first_file
        FROM silver WHERE seq % 61 NOT IN (5, 6, 7) GROUP BY 1, 2, 3
        UNION ALL SELECT 'local-run', 'accepted', 'accepted', count(*), 0, count(*), 'part-0.tif' FROM silver WHERE seq % 61 = 7 HAVING count(*) > 0
        UNION ALL SELECT 'quarantine', CASE WHEN seq % 61 = 5 THEN '{not json' ELSE '[1, 2]' END, '', count(*), 0, 0, ''
        FROM silver WHERE seq % 61 IN (5, 6) GROUP BY seq % 61"""),
    "evidence_scan": with_ctes("candidates", then="""
        SELECT run_id, ocr_status AS status, count(*) AS documents, count(*) FILTER (ocr_status = 'failed') AS errors,
          count(*) FILTER (ocr_status = 'failed') AS empty_responses FROM candidates GROUP BY 1, 2"""),
    "idempotent_skip": with_ctes("silver", then="SELECT seq, run_id, document_id FROM silver WHERE outcome <> 'valid'"),
    "already_processed": with_ctes("silver", then="SELECT run_id, count(*) AS skipped FROM silver WHERE outcome = 'valid' GROUP BY 1"),
    "batch_completeness": with_ctes("batches", then="SELECT * FROM batches"),
    "batch_missing": with_ctes("matched", then="""
        SELECT batch_id, run_id, document_id, 'raw/lost/' || document_id || '.pdf' AS source_s3_key, document_id || '.pdf' AS source_file_name
        FROM matched WHERE outcome IS NULL AND problem IS NULL"""),
    "batch_refused": with_ctes("expected", then="""
        SELECT batch_id, document_id AS source_s3_key, problem FROM expected WHERE problem IS NOT NULL"""),
    "batch_manifest": with_ctes("batches", "batch_gold", then="""
        SELECT b.status, b.batch_id, b.expected_count, b.valid_count, b.rejected_count, b.failed_count,
          count(g.seq) AS gold_row_count, count(*) FILTER (g.is_duplicate) AS duplicate_count,
          count(*) FILTER (g.seq IS NOT NULL AND g.document_date IS NULL) AS missing_date_count,
          count(*) FILTER (g.seq IS NOT NULL AND g.total_amount IS NULL) AS missing_amount_count, 0::BIGINT AS enrichment_invoked_count,
          CASE WHEN count(g.seq) = 0 THEN 0.0 ELSE round(count(g.document_date) / count(g.seq), 4) END AS date_completion_rate,
          CASE WHEN count(g.seq) = 0 THEN 0.0 ELSE round(count(g.total_amount) / count(g.seq), 4) END AS amount_completion_rate,
          b.run_ids, '2000-12-31T00:00:00Z' AS created_at, 'gold/documents/batch_id=' || b.batch_id AS parquet_key,
          'gold/manifests/batch_id=' || b.batch_id AS manifest_key
        FROM batches b LEFT JOIN batch_gold g ON g.batch_id = b.batch_id WHERE b.status = 'completed'
        GROUP BY b.status, b.batch_id, b.expected_count, b.valid_count, b.rejected_count, b.failed_count, b.run_ids"""),
    "completion_metrics": with_ctes("gold", then=f"SELECT count(*) AS rows, {_RATES}, {_UNKNOWN} FROM gold"),
    "completion_by_run": with_ctes("gold", then=f"SELECT run_id, count(*) AS rows, {_RATES}, {_UNKNOWN} FROM gold GROUP BY run_id"),
    "preview_metrics": with_ctes("gold", then="""
        SELECT count(*) AS rows, round(count(vendor_name) / count(*), 4) AS vendor_completion_rate,
          round(count(document_date) / count(*), 4) AS date_completion_rate,
          round(count(total_amount) / count(*), 4) AS amount_completion_rate FROM gold"""),
    "silver_completion": with_ctes("silver", then=f"SELECT count(*) AS rows, {_RATES} FROM silver"),
    "type_counts": with_ctes("silver", then="""
        SELECT CASE WHEN outcome <> 'failed' THEN document_type END AS document_type, count(*) AS documents FROM silver GROUP BY 1"""),
    "flag_counts": with_ctes("silver", then="SELECT flag, count(*) AS documents FROM (SELECT unnest(flags) AS flag FROM silver) GROUP BY flag"),
    "silver_run_metrics": with_ctes("silver", then="""
        SELECT run_id, count(*) AS total, count(*) FILTER (outcome = 'valid') AS succeeded, count(*) FILTER (outcome = 'rejected') AS rejected,
          count(*) FILTER (outcome = 'failed') AS failed, round(count(*) FILTER (outcome = 'valid') / count(*), 4) AS success_rate,
          sum(duration_seconds) AS elapsed_seconds, round(avg(duration_seconds), 4) AS avg_doc_seconds,
          min(duration_seconds) AS min_doc_seconds, max(duration_seconds) AS max_doc_seconds,
          round(count(*) FILTER (outcome = 'valid') * 60.0::DOUBLE / sum(duration_seconds), 4) AS docs_per_minute FROM silver GROUP BY run_id"""),
    "bronze_run_metrics": with_ctes("candidates", then="""
        SELECT run_id, count(*) AS total, count(*) FILTER (ocr_status = 'success') AS succeeded, count(*) FILTER (ocr_status = 'failed') AS failed,
          round(count(*) FILTER (ocr_status = 'success') / count(*), 4) AS success_rate, sum(duration_seconds) AS elapsed_seconds,
          round(count(*) FILTER (ocr_status = 'success') / sum(duration_seconds), 4) AS docs_per_second FROM candidates GROUP BY run_id"""),
    "run_summary": with_ctes("run_summary", then="""
        SELECT * REPLACE (round(amount_completion_rate, 4) AS amount_completion_rate, round(date_completion_rate, 4) AS date_completion_rate,
          round(vendor_completion_rate, 4) AS vendor_completion_rate, round(currency_completion_rate, 4) AS currency_completion_rate,
          round(unknown_document_type_rate, 4) AS unknown_document_type_rate) FROM run_summary"""),
    "acceptance_gate": with_ctes("run_summary", then="""
        , m AS (SELECT *, documents_processed / documents_received AS processed_rate, documents_failed / documents_received AS failure_rate FROM run_summary),
        c AS (
          SELECT run_id, 'documents_processed_rate' AS "check", processed_rate AS value, '>=' AS comparison, 0.95 AS lim FROM m
          UNION ALL SELECT run_id, 'technical_failure_rate', failure_rate, '<=', 0.05 FROM m
          UNION ALL SELECT run_id, 'vendor_completion_rate', vendor_completion_rate, '>=', 0.85 FROM m
          UNION ALL SELECT run_id, 'date_completion_rate', date_completion_rate, '>=', 0.85 FROM m
          UNION ALL SELECT run_id, 'amount_completion_rate', amount_completion_rate, '>=', 0.90 FROM m
          UNION ALL SELECT run_id, 'unknown_document_type_rate', unknown_document_type_rate, '<=', 0.20 FROM m
          UNION ALL SELECT run_id, 'rejected_without_reason', 0.0, '<=', 0.0 FROM m
          UNION ALL SELECT run_id, 'critical_errors_in_gold', 0.0, '<=', 0.0 FROM m)
        SELECT run_id, "check", round(value, 4)::DOUBLE AS value, comparison, lim::DOUBLE AS "limit",
          CASE comparison WHEN '>=' THEN value >= lim ELSE value <= lim END AS passed FROM c"""),
    "latency_percentiles": """
        WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
        SELECT max(value) FILTER (i = least(n - 1, round_even(0.5 * (n - 1), 0))) AS p50,
          max(value) FILTER (i = least(n - 1, round_even(0.95 * (n - 1), 0))) AS p95, max(value) AS max, round(avg(value), 4) AS avg, count(*) AS n FROM r""",
    "latency_by_run": with_ctes("silver", then="""
        , r AS (SELECT run_id, duration_seconds AS value, row_number() OVER (PARTITION BY run_id ORDER BY duration_seconds) - 1 AS i,
               count(*) OVER (PARTITION BY run_id) AS n FROM silver)
        SELECT run_id, max(value) FILTER (i = least(n - 1, round_even(0.5 * (n - 1), 0))) AS p50,
          max(value) FILTER (i = least(n - 1, round_even(0.95 * (n - 1), 0))) AS p95, max(value) AS max, round(avg(value), 4) AS avg, count(*) AS n
        FROM r GROUP BY run_id"""),
    "metric_rollup": with_ctes("metrics", then="SELECT run_id, metric_name, count(*)::DOUBLE AS value FROM metrics GROUP BY 1, 2"),
    "metric_table": with_ctes("metrics", then="SELECT run_id, " + ", ".join(
        f"nullif(count(*) FILTER (metric_name = '{m}'), 0)::DOUBLE AS {m}" for m in (
            "DocumentsProcessed", "DocumentsAccepted", "DocumentsRejected", "DocumentsFailed", "VendorFieldPresent",
            "DateFieldPresent", "AmountFieldPresent", "UnknownDocumentType")) + " FROM metrics GROUP BY run_id"),
    "statement_telemetry": """
        SELECT CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status, count(*) AS statements,
          round(avg(ms), 4) AS mean_ms, max(ms) AS max_ms, round(sum((event_id % 64) / 4.0::DOUBLE), 4) AS scan_mb, avg(ms) <= 10000 AS within_budget
        FROM (SELECT *, CAST(trunc(value * 100) AS BIGINT) AS ms FROM events) GROUP BY 1""",
    "orders_curated": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS order_total, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date
        FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice IS NOT NULL""",
    "orders_key_check": """
        SELECT (SELECT count(*) FROM lineitem WHERE l_linenumber = 7) AS null_keys,
          (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys""",
    "q_docs_per_vendor": with_ctes("gold", then="SELECT vendor_name, count(document_id) AS documents FROM gold GROUP BY 1"),
    "q_latest_batch_per_vendor": with_ctes("gold", then="""
        SELECT vendor_name, count(document_id) AS documents FROM gold WHERE batch_id = (SELECT max(batch_id) FROM gold) GROUP BY 1"""),
    "q_vendor_spend": with_ctes("gold", then="""
        SELECT round(sum(total_amount), 2) AS total, count(document_id) AS invoices FROM gold
        WHERE lower(vendor_name) = 'customer#000000042' AND document_date BETWEEN '1995-01-01' AND '2000-06-30'"""),
    "q_total_spend": with_ctes("summary", then="SELECT round(sum(total_amount), 2) AS total_spend FROM summary"),
    "q_total_spend_by_currency": with_ctes("dedup", then="SELECT currency, round(sum(total_amount), 2) AS total_spend FROM dedup GROUP BY 1"),
    "q_top_suppliers": with_ctes("dedup", then="""
        SELECT supplier_name, round(sum(total_amount), 2) AS total_amount FROM dedup GROUP BY 1
        ORDER BY sum(total_amount) DESC NULLS LAST, supplier_name NULLS LAST LIMIT 5"""),
    "q_top_suppliers_month": with_ctes("dedup", then="""
        SELECT supplier_name, round(sum(total_amount), 2) AS total_amount FROM dedup WHERE invoice_date LIKE '2000-11%' GROUP BY 1
        ORDER BY sum(total_amount) DESC NULLS LAST, supplier_name NULLS LAST LIMIT 10"""),
    "q_processed_last_month": with_ctes("summary", then="""
        SELECT count(invoice_id) AS invoices FROM summary WHERE processing_date >= '2000-11-01' AND processing_date < '2000-12-01'"""),
    "q_processed_last_week": with_ctes("summary", then="""
        SELECT count(invoice_id) AS invoices FROM summary WHERE processing_date >= '2000-12-18' AND processing_date < '2000-12-25'"""),
    "q_failed_invoices": with_ctes("latest", then="SELECT invoice_id, run_id, status, updated_at FROM latest WHERE status = 'Failed'"),
    "q_invoice_count": with_ctes("summary", then="SELECT count(invoice_id) AS invoices FROM summary"),
    "q_total_by_supplier": with_ctes("dedup", then="""
        SELECT supplier_name, round(sum(total_amount), 2) AS total_amount, count(invoice_id) AS invoices FROM dedup GROUP BY 1"""),
    "q_by_currency": with_ctes("summary", then="SELECT currency, count(invoice_id) AS invoices FROM summary GROUP BY 1"),
    "q_bounded_rows": with_ctes("summary", then="""
        SELECT invoice_id, supplier_name, processing_date FROM summary ORDER BY processing_date DESC, invoice_id LIMIT 100"""),
    "sql_surface_joins": with_ctes("gold", then="""
        SELECT n.n_name AS nation, count(g.document_id) AS documents, count(DISTINCT c.c_custkey) AS vendors, round(sum(g.total_amount), 2) AS total
        FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN gold g ON g.vendor_name = c.c_name GROUP BY 1"""),
    "sql_surface_right_join": with_ctes("gold", then="""
        SELECT c.c_mktsegment AS segment, count(g.document_id) AS documents, count(*) AS rows_seen
        FROM gold g RIGHT JOIN customer c ON g.vendor_name = c.c_name AND g.currency = 'EUR' GROUP BY 1"""),
    "sql_surface_dates": with_ctes("summary", then="""
        SELECT CAST(year(d) AS INTEGER) AS y, CAST(month(d) AS INTEGER) AS m, count(*) AS invoices, CAST(max(day(d)) AS INTEGER) AS last_day,
          CAST(CAST(date_trunc('month', max(d)) AS DATE) AS VARCHAR) AS month_start
        FROM (SELECT CAST(invoice_date AS DATE) AS d FROM summary WHERE invoice_date BETWEEN '1995-01-01' AND '2000-12-31')
        GROUP BY 1, 2"""),
    "sql_surface_case": with_ctes("summary", then="""
        SELECT CASE WHEN total_amount IS NULL THEN 'none' WHEN total_amount < 100000 THEN 'small' ELSE 'large' END AS band,
          upper(coalesce(currency, 'n/a')) AS money, lower(document_type) AS kind, count(*) AS invoices,
          round(min(total_amount), 2) AS low, round(max(total_amount), 2) AS high,
          CAST(round(sum(CAST(total_amount AS DECIMAL(18,2))) / CAST(count(total_amount) AS DECIMAL(18,0)), 2) AS DOUBLE) AS mean
        FROM summary
        WHERE NOT (supplier_name LIKE '%7_' OR currency IN ('PEN')) OR supplier_name IS NULL OR currency IS NULL GROUP BY 1, 2, 3"""),
    "sql_surface_having": with_ctes("summary", then="""
        SELECT supplier_name, count(*) AS invoices, count(DISTINCT currency) AS currencies FROM summary GROUP BY 1 HAVING count(*) > 5
        ORDER BY invoices DESC NULLS LAST, supplier_name ASC NULLS LAST LIMIT 100"""),
    "sql_surface_distinct": with_ctes("gold", then="SELECT DISTINCT document_type, currency, quality_status FROM gold"),
    "approx_distinct": with_ctes("gold", then="""
        SELECT currency, count(DISTINCT vendor_name) AS exact, true AS close FROM gold GROUP BY 1"""),
    "status_latest": with_ctes("latest", then="SELECT * FROM latest"),
    "status_forward": with_ctes("status_events", then="""
        SELECT run_id, invoice_id, status, updated_at, sequence FROM status_events
        QUALIFY row_number() OVER (PARTITION BY run_id, invoice_id ORDER BY step DESC, updated_at DESC, sequence DESC) = 1"""),
    "status_page": with_ctes("latest", then="""
        SELECT invoice_id, status, updated_at FROM latest WHERE status = 'Completed' AND invoice_id > 'doc-1' ORDER BY invoice_id LIMIT 20"""),
    "status_next_token": with_ctes("latest", then="""
        SELECT CASE WHEN (SELECT max(invoice_id) FROM latest) > max(invoice_id) THEN max(invoice_id) END AS next_token
        FROM (SELECT invoice_id FROM latest ORDER BY invoice_id LIMIT 7)"""),
    "status_enriched": with_ctes("latest", "gold", then="""
        SELECT l.invoice_id, l.run_id, l.status, CASE WHEN l.status = 'Completed' THEN g.vendor_name END AS supplier_name,
          CASE WHEN l.status = 'Completed' THEN g.document_date END AS invoice_date,
          CASE WHEN l.status = 'Completed' THEN g.total_amount END AS total_amount, CASE WHEN l.status = 'Completed' THEN g.currency END AS currency
        FROM latest l LEFT JOIN gold g ON g.run_id = l.run_id AND g.document_id = l.invoice_id"""),
    "status_derived": with_ctes("matched", "batches", then="""
        SELECT CASE WHEN outcome IN ('rejected', 'failed') THEN 'Failed' WHEN outcome = 'valid' AND b.status = 'completed' THEN 'Completed'
          WHEN outcome = 'valid' THEN 'Consolidating' ELSE 'Processing' END AS status, count(*) AS documents
        FROM matched m JOIN batches b ON b.batch_id = m.batch_id WHERE problem IS NULL GROUP BY 1"""),
    "stream_ingest": with_ctes("bronze", then="""
        SELECT b.run_id, b.source_s3_key, CASE WHEN b.source_s3_key LIKE '%.docx' THEN 'unsupported_extension'
          WHEN CAST(o.o_orderdate AS DATE) > DATE '2000-12-31' OR CAST(o.o_totalprice AS DECIMAL(18,2)) > 1000000 THEN 'rejected' ELSE 'valid' END AS outcome
        FROM bronze b JOIN orders o ON o.o_orderkey = b.seq"""),
    "stream_gold": with_ctes("gold", then="SELECT seq, is_duplicate, duplicate_of_document_id, duplicate_strategy FROM gold"),
    "stream_status": with_ctes("status_events", then="""
        SELECT invoice_id, status, sequence FROM status_events
        QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY step DESC, ts DESC, sequence DESC) = 1"""),
    "alarm_windows": "",
    "stream_alarms": "",
    "dead_letter": """
        SELECT 'm-' || user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS message_id, count(*) AS failures,
          'error ' || CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS last_error
        FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 3""",
    "skewed_lookup": """
        SELECT event_id, event_type, CASE WHEN event_type IS NOT NULL THEN count(*) OVER (PARTITION BY event_type) END AS type_events FROM events""",
}

_WINDOWS = """
  SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, count(*) FILTER (event_type = 'error') AS failures,
    avg(CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.0 END) AS unknown_rate FROM events GROUP BY 1"""
_WINDOW_ROWS = """
  SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end,
    failures, round(unknown_rate, 4) AS unknown_rate, failures > 0 AS failures_alarm, coalesce(unknown_rate > 0.2, false) AS unknown_rate_alarm"""
ORACLES["alarm_windows"] = f"{_WINDOW_ROWS} FROM ({_WINDOWS}) WHERE failures > 0 OR unknown_rate > 0.2"
ORACLES["stream_alarms"] = f"""{_WINDOW_ROWS} FROM ({_WINDOWS})
  WHERE w + INTERVAL 5 MINUTE <= (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 10 MINUTE FROM events)"""


# --- contract reports: every check counted by hand ------------------------------


def _report(contract: str, source: str, required, enums, typed, undeclared, nulls: dict[str, str]) -> str:
    parts = []

    def add(kind: str, column: str, count: str) -> None:
        parts.append(f"SELECT '{contract}' AS contract, '{kind}' AS \"check\", '{column}' AS \"column\", CAST({count} AS BIGINT) AS violations FROM {source}")

    for c in required:
        add("required", c, f"count(*) FILTER ({nulls[c]} IS NULL)" if c in nulls else "0 * count(*)")
    for c in enums:
        add("enum", c, "0 * count(*)")
    for c in typed:
        add("type", c, "0 * count(*)")
    for c in undeclared:
        add("undeclared", c, "count(*)")
    return "\nUNION ALL ".join(parts)


from docpipe import schemas as _schemas  # noqa: E402  (column lists only)

ORACLES["contract_report"] = with_ctes("silver", then=_report(
    "silver_document", "silver",
    ["run_id", "document_id", "source_s3_key", "source_file_name", "document_type", "extraction_engine",
     "quality_status", "quality_score", "quality_flags", "processing_status", "created_at"],
    ["document_type", "processing_status", "quality_status", "duplicate_strategy"],
    _schemas.SILVER.fieldNames(), ["seq"], {"created_at": "created_at"}))
ORACLES["contract_report_gold"] = with_ctes("gold", then=_report(
    "gold_documents", "gold",
    ["run_id", "document_id", "source_s3_key", "source_file_name", "document_type", "processing_status", "quality_status",
     "quality_flags", "document_fingerprint", "business_key", "is_duplicate", "duplicate_strategy", "duplicate_confidence", "created_at"],
    ["duplicate_strategy"], _schemas.GOLD.fieldNames(), [], {"business_key": "business_key"}))
ORACLES["contract_report_bronze"] = with_ctes("bronze", then=_report(
    "bronze_evidence", "bronze",
    ["run_id", "document_id", "source_s3_key", "source_file_name", "textract_response", "extraction_engine",
     "extraction_timestamp", "status"],
    ["extraction_engine", "status"], _schemas.BRONZE_EVIDENCE.fieldNames(), [], {}))


# --- tables over many deliveries, names, contracts, catalog, micro-batches --------


def _in_parts(source: str, by: str, parts: int) -> str:
    """``source`` with ``part``: the micro-batch of a row when a stream takes the rows in that many equal spans of ``by``."""
    return f"""SELECT *, ({by} - min({by}) OVER ()) // ((max({by}) OVER () - min({by}) OVER ()) // {parts} + 1) AS part FROM {source}"""


ORACLES["free_names"] = r"""
  WITH m AS (
    SELECT concat('f', o_orderkey % 300, CASE WHEN o_orderkey % 7 = 3 THEN concat('_', o_orderkey % 6) ELSE '' END) AS stem,
      CASE o_orderkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.tif' ELSE '' END AS tail, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS path FROM orders
  ), folder AS (
    SELECT DISTINCT concat('f', c_custkey % 300, CASE WHEN c_custkey % 4 = 1 THEN concat('_', c_custkey % 9) ELSE '' END) AS stem, '.pdf' AS tail FROM customer
  ), held AS (
    SELECT stem, tail FROM m UNION SELECT stem, tail FROM folder
  ), numbers AS (
    SELECT regexp_extract(stem, '^(.+)_([1-9][0-9]*)$', 1) AS stem, tail, list(CAST(regexp_extract(stem, '^(.+)_([1-9][0-9]*)$', 2) AS BIGINT)) AS used
    FROM held WHERE regexp_matches(stem, '^.+_[1-9][0-9]*$') GROUP BY 1, 2
  ), placed AS (
    SELECT m.*, row_number() OVER (PARTITION BY m.stem, m.tail ORDER BY path) - CASE WHEN f.stem IS NULL THEN 1 ELSE 0 END AS k
    FROM m LEFT JOIN folder f ON f.stem = m.stem AND f.tail = m.tail
  )
  SELECT path, CASE WHEN k = 0 THEN p.stem || p.tail ELSE p.stem || '_' ||
      list_filter(range(1, k + coalesce(len(used), 0) + 1), lambda x: NOT list_contains(coalesce(used, []), x))[k] || p.tail END AS target_name
  FROM placed p LEFT JOIN numbers n ON n.stem = p.stem AND n.tail = p.tail"""
ORACLES["compacted_outcomes"] = ORACLES["rerun_outcomes"]
ORACLES["status_log"] = with_ctes("status_events", then="SELECT invoice_id, max(updated_at) AS updated_at FROM status_events GROUP BY 1")
ORACLES["bronze_text_scan"] = "SELECT concat('scan-', s_suppkey, '.tif') AS source_file, 8 AS lines, true AS has_path FROM supplier"
ORACLES["runs_table"] = with_ctes("run_summary", then="""
  SELECT run_id, documents_received, documents_accepted, documents_rejected, documents_failed FROM run_summary""")
ORACLES["manifest_files"] = with_ctes("batches", "batch_gold", then="""
  SELECT b.batch_id, b.status, b.expected_count, count(g.seq) AS gold_row_count, count(*) FILTER (g.is_duplicate) AS duplicate_count, b.run_ids
  FROM batches b LEFT JOIN batch_gold g ON g.batch_id = b.batch_id WHERE b.status = 'completed' GROUP BY ALL""")
_SHAPES = " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in STATEMENT_SHAPES.items())
_SPEND = "concat('SELECT sum(total_amount) AS total FROM gold_invoice_summary WHERE lower(supplier_name) = ''vendor ', user_id, ''' LIMIT ', event_id % 1500)"
ORACLES["statement_extract"] = f"""
  WITH s AS (SELECT event_id AS query_id, event_id % 4 AS form, CASE event_id % {len(STATEMENT_SHAPES) + 1} {_SHAPES} ELSE {_SPEND} END AS q FROM events)
  SELECT query_id, md5(CASE WHEN form = 2 THEN trim('```SQL ' || q, {_WS}) ELSE trim(q, {_WS}) END) AS statement_md5 FROM s"""
ORACLES["chained_run"] = with_ctes("eligible", "run_summary", then=f"""
  SELECT s.run_id, documents_received, documents_accepted, documents_rejected, documents_failed, count(g.seq) AS gold_rows,
    count(*) FILTER (g.is_duplicate) AS gold_duplicates
  FROM run_summary s LEFT JOIN ({marks('eligible', "run_id >= 'run-2', seq")}) g ON g.run_id = s.run_id GROUP BY ALL""")
ORACLES["contract_violations"] = with_ctes("silver", then="""
  SELECT source_s3_key, concat_ws(',', CASE WHEN seq % 15 = 7 THEN 'required:quality_status' END, CASE WHEN created_at IS NULL THEN 'required:created_at' END,
      CASE WHEN seq % 10 = 4 THEN 'enum:document_type' END) AS violations
  FROM silver WHERE seq % 15 = 7 OR created_at IS NULL OR seq % 10 = 4""")
ORACLES["contract_enforced"] = with_ctes("silver", then="""
  SELECT run_id, CASE WHEN created_at IS NULL THEN 'refused' ELSE 'accepted' END AS table_name, count(*) AS documents FROM silver GROUP BY 1, 2""")
ORACLES["catalog_latest_batch"] = with_ctes("gold", then="""
  SELECT batch_id, vendor_name, count(document_id) AS documents FROM gold WHERE batch_id = (SELECT max(batch_id) FROM gold) GROUP BY 1, 2""")
ORACLES["sql_surface_date_parse"] = with_ctes("summary", then="""
  SELECT year(CAST(invoice_date AS DATE)) AS y, month(CAST(invoice_date AS DATE)) AS m, count(*) AS invoices, 8 AS first_hour
  FROM summary WHERE invoice_date >= '1995-02-01' GROUP BY 1, 2""")
ORACLES["sql_surface_approx_distinct"] = with_ctes("summary", then="""
  SELECT currency, count(DISTINCT supplier_name) AS suppliers, true AS close FROM summary GROUP BY 1""")
ORACLES["distinct_sketches"] = with_ctes("gold", then="""
  SELECT substr(batch_id, 7, 4) AS year, count(*) AS rows, count(DISTINCT vendor_name) AS vendors, count(DISTINCT document_id) AS documents,
    true AS vendors_close, true AS documents_close FROM gold GROUP BY 1""")
ORACLES["stream_gold_batches"] = ORACLES["stream_gold"]
ORACLES["stream_ingest_batches"] = with_ctes("bronze", then="""
  SELECT outcome, CASE outcome WHEN 'valid' THEN count(*) ELSE 2 * count(*) END AS rows_written, count(*) AS documents
  FROM (SELECT CASE WHEN CAST(o.o_orderdate AS DATE) > DATE '2000-12-31' OR CAST(o.o_totalprice AS DECIMAL(18,2)) > 1000000 THEN 'rejected' ELSE 'valid' END AS outcome
        FROM bronze b JOIN orders o ON o.o_orderkey = b.seq WHERE b.source_s3_key NOT LIKE '%.docx') GROUP BY outcome""")
ORACLES["stream_dead_letter"] = f"""
  WITH p AS ({_in_parts('events', 'event_id', 4)}), f AS (
    SELECT concat('m-', user_id % 500) AS message_id, event_id, part, row_number() OVER (PARTITION BY user_id % 500 ORDER BY event_id) AS n
    FROM p WHERE event_type = 'error'
  ), hit AS (SELECT message_id, part FROM f WHERE n = 3)
  SELECT message_id, count(*) AS failures, concat('error ', max(event_id)) AS last_error, CAST(hit.part AS BIGINT) AS epoch
  FROM hit JOIN f USING (message_id) WHERE f.part <= hit.part GROUP BY message_id, hit.part"""
ORACLES["alarm_calendar"] = f"""
  WITH w AS ({_WINDOWS}), c AS (SELECT unnest(generate_series((SELECT min(w) FROM w), (SELECT max(w) FROM w), INTERVAL 5 MINUTE)) AS w)
  {_WINDOW_ROWS} FROM (SELECT c.w, coalesce(failures, 0) AS failures, unknown_rate FROM c LEFT JOIN w ON w.w = c.w)"""
ORACLES["stream_alarm_calendar"] = ORACLES["alarm_calendar"]


def _status_steps(parts: int, stuck: str, keep: str) -> str:
    """The live table after each micro-batch, one after another."""
    timed = "(SELECT *, CAST(updated_at AS TIMESTAMP) AS moment, CAST(epoch(CAST(updated_at AS TIMESTAMP)) AS BIGINT) AS second FROM status_events)"
    steps = [f"""e AS ({_in_parts(timed, "second", parts)}),
    l_0 AS (SELECT invoice_id, status, moment, sequence, false AS timed_out, moment AS seen FROM e WHERE false)"""]
    for n in range(parts):
        steps.append(f"""
    k_{n} AS (SELECT invoice_id, status, moment, sequence, timed_out, seen FROM l_{n}
      UNION ALL SELECT invoice_id, status, moment, sequence, false, moment FROM e WHERE part = {n}),
    b_{n} AS (SELECT *, (SELECT max(seen) FROM k_{n}) AS clock FROM k_{n} QUALIFY row_number() OVER (PARTITION BY invoice_id
      ORDER BY CASE status WHEN 'Uploaded' THEN 0 WHEN 'Processing' THEN 1 WHEN 'Consolidating' THEN 2 ELSE 3 END DESC, moment DESC, sequence DESC) = 1),
    a_{n} AS (SELECT invoice_id, CASE WHEN late THEN 'Failed' ELSE status END AS status, moment, sequence, timed_out OR late AS timed_out, clock AS seen
      FROM (SELECT *, status NOT IN ('Completed', 'Failed') AND moment < clock - INTERVAL {stuck} AS late FROM b_{n})),
    l_{n + 1} AS (SELECT * FROM a_{n} WHERE NOT (status IN ('Completed', 'Failed') AND moment < seen - INTERVAL {keep}))""")
    return ",".join(steps)


ORACLES["stream_status_limit"] = with_ctes("status_events", then="").rstrip() + ", " + _status_steps(3, "3 DAY", "5 DAY") + """
  SELECT invoice_id, status, sequence, timed_out FROM l_3"""
