"""Ingest steps as registered queries, over files made of the test tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payproof.plans import bridge
from payproof.plans.registry import register
from payproof.plans.reviews import reg
from payproof.scale import checkpointed
from payproof.sources import answer_key, headers, lines, reports, tables

# ---------------------------------------------------------------- bytes, lines, names
_CHARSET = "CASE WHEN doc_id % 4 = 1 THEN 'UTF-16' WHEN doc_id % 4 = 2 THEN 'UTF-16LE' WHEN doc_id % 4 = 3 AND text RLIKE '^[\\x00-\\x7f\\xa1-\\xff]*$' THEN 'ISO-8859-1' ELSE 'UTF-8' END"


def _encoded(spark: SparkSession, folder: str) -> DataFrame:
    d = bridge.table(spark, folder, "documents").withColumn("charset", F.expr(_CHARSET.replace("\\", "\\\\")))
    content = F.coalesce(*[F.when(F.col("charset") == c, F.encode("text", c)) for c in ("UTF-16", "UTF-16LE", "ISO-8859-1", "UTF-8")])
    return d.select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))


register("src_decode", lambda spark, folder: lines.decode_files(_encoded(spark, folder)).select(F.col("path").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5")),
         "SELECT doc_id, md5(replace(text, chr(0), '')) AS text_md5 FROM documents")


def _document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.split_lines(bridge.table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id", "source")


_SPLIT = "regexp_split_to_array(regexp_replace(text, '(\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}])$', ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')"
register("src_lines", lambda spark, folder: _document_lines(spark, folder).select("doc_id", "line_number", F.md5("text").alias("text_md5")), f"""
    WITH l AS (SELECT doc_id, {_SPLIT} AS parts FROM documents WHERE text <> '')
    SELECT doc_id, CAST(i AS BIGINT) AS line_number, md5(parts[i]) AS text_md5 FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM l)""")

_PATHS = """
SELECT 'N' || CAST(c_nationkey AS STRING) AS dataset_id, 'in/' || CAST(c_custkey AS STRING) || '/' || CASE c_custkey % 9 WHEN 0 THEN 'payments.csv' WHEN 1 THEN 'ACME_Vendors.CSV' WHEN 2 THEN 'bank_statement_2026.csv'
  WHEN 3 THEN 'Bill Payment List.csv' WHEN 4 THEN 'payment_run.tsv' WHEN 5 THEN 'expenses_q3.txt' WHEN 6 THEN 'mypayments.csv' WHEN 7 THEN 'approvals' ELSE 'site_payments.csv' END AS path
FROM {customer}"""
bridge.VIEWS["paths"] = _PATHS
_KIND = ("CASE split_part(path, '/', 3) WHEN 'payments.csv' THEN 'payments.csv' WHEN 'ACME_Vendors.CSV' THEN 'vendors.csv' WHEN 'bank_statement_2026.csv' THEN 'bank_statement.csv' WHEN 'payment_run.tsv' THEN 'payment_run.csv' "
         "WHEN 'expenses_q3.txt' THEN 'expenses.csv' WHEN 'approvals' THEN 'approvals.csv' WHEN 'site_payments.csv' THEN 'payments.csv' END")
reg("src_kind_by_name", lambda p: p.select("path", lines.kind_of(F.col("path")).alias("kind")), ["paths"], f"SELECT path, {_KIND} AS kind FROM paths")


def _slots(p: DataFrame) -> DataFrame:
    kind = lines.kind_of(F.col("path"))
    return lines.one_per_slot(p.withColumn("named", kind.isNotNull()).withColumn("kind", F.coalesce(kind, F.lit("payments.csv")))).select("dataset_id", "kind", "path", "kept")


reg("src_slot_dedupe", _slots, ["paths"], f"""WITH k AS (SELECT dataset_id, path, {_KIND} AS kind0 FROM paths)
    SELECT dataset_id, coalesce(kind0, 'payments.csv') AS kind, path, row_number() OVER (PARTITION BY dataset_id, coalesce(kind0, 'payments.csv') ORDER BY kind0 IS NULL, path) = 1 AS kept FROM k""")


def _one_line_documents(spark: SparkSession, folder: str) -> DataFrame:
    return bridge.table(spark, folder, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("line_number"), F.translate("text", "\n", " ").alias("text"))


register("src_limits", lambda spark, folder: lines.long_line_notes(_one_line_documents(spark, folder), "source_file"),
         "SELECT source AS source_file, count(*) AS cut_lines, min(doc_id) AS first_cut FROM documents WHERE length(text) > 4000 GROUP BY source")

# ---------------------------------------------------------------- files in several dialects
# by dataset: commas and ISO dates; semicolons, d/m/y and decimal commas; tabs and m/d/y; commas with values broken over two lines
_DAY = "CAST(extract(day FROM {0}) AS STRING)"
_MON = "CAST(extract(month FROM {0}) AS STRING)"
_YEAR = "CAST(extract(year FROM {0}) AS STRING)"


def _dmy(c: str, first: str, second: str) -> str:
    return f"{first.format(c)} || '/' || {second.format(c)} || '/' || {_YEAR.format(c)}"


_AMT = "CAST(CAST({0} AS DECIMAL(18,2)) AS STRING)"
_COLS = ["payment_id", "pay_date", "invoice_date", "supplier", "invoice_no", "invoice_amount", "paid_amount"]


def _row(sep: str, dates: list[str], amounts: list[str], supplier: str) -> str:
    return f" || '{sep}' || ".join(["payment_id", *dates, supplier, "invoice_no", *amounts])


_ISO = ["CAST(pay_date AS STRING)", "CAST(invoice_date AS STRING)"]
_POINT = [_AMT.format("invoice_amount"), _AMT.format("paid_amount")]
_COMMA = [f"replace({a}, '.', ',')" for a in _POINT]
_THOUSAND = "CASE WHEN line_number % 22 = 0 THEN '1.234' ELSE " + _COMMA[0] + " END"
RAWFILES = f"""
WITH p AS (SELECT *, CAST(substr(dataset_id, 2) AS INT) % 4 AS k, line_number % 10 = 0 AND line_number % 194 >= 4 AND line_number % 2 = 0 AS broken FROM ({bridge.PAYMENTS}))
SELECT dataset_id, 'payments.csv' AS source_file, CAST(1 AS BIGINT) AS line_number, CASE k WHEN 1 THEN '{";".join(_COLS)}' WHEN 2 THEN ' Payment-ID{chr(9)}Pay Date{chr(9)}{chr(9).join(_COLS[2:])}'
       ELSE '{",".join(_COLS)}' END AS text FROM (SELECT DISTINCT dataset_id, k FROM p)
UNION ALL
SELECT dataset_id, 'payments.csv', line_number, CASE WHEN k = 1 AND broken THEN {" || ';' || ".join(["payment_id", _dmy('pay_date', _DAY, _MON), _dmy('invoice_date', _DAY, _MON)])} || ';"' || substr(supplier, 1, 8)
       WHEN k = 2 AND broken THEN {f" || '{chr(9)}' || ".join(["payment_id", _dmy('pay_date', _MON, _DAY), _dmy('invoice_date', _MON, _DAY)])} || '{chr(9)}"' || substr(supplier, 1, 8)
       WHEN k = 1 THEN {_row(';', [_dmy('pay_date', _DAY, _MON), _dmy('invoice_date', _DAY, _MON)], [_THOUSAND, _COMMA[1]], 'supplier')}
       WHEN k = 2 THEN {_row(chr(9), [_dmy('pay_date', _MON, _DAY), _dmy('invoice_date', _MON, _DAY)], _POINT, 'supplier')}
       WHEN k = 3 AND broken THEN payment_id || ',' || {_ISO[0]} || ',' || {_ISO[1]} || ',"' || substr(supplier, 1, 8)
       WHEN k = 3 THEN {_row(',', _ISO, _POINT, "'" + '"' + "' || supplier || '" + '"' + "'")}
       ELSE {_row(',', _ISO, _POINT, 'supplier')} END FROM p
UNION ALL
SELECT dataset_id, 'payments.csv', line_number + 1, CASE k WHEN 1 THEN substr(supplier, 9) || '";' || invoice_no || ';' || {_THOUSAND} || ';' || {_COMMA[1]}
       WHEN 2 THEN substr(supplier, 9) || '"{chr(9)}' || invoice_no || '{chr(9)}' || {_POINT[0]} || '{chr(9)}' || {_POINT[1]}
       ELSE substr(supplier, 9) || '",' || invoice_no || ',' || {_POINT[0]} || ',' || {_POINT[1]} END FROM p WHERE k IN (1, 2, 3) AND broken"""
bridge.VIEWS["rawfiles"] = RAWFILES
_K = "CAST(substr(dataset_id, 2) AS INT) % 4"
_WHOLE = """
    SELECT a.dataset_id, a.line_number, CASE WHEN b.line_number IS NULL THEN a.text ELSE a.text || ' ' || b.text END AS text
    FROM (SELECT * FROM rawfiles WHERE line_number = 1 OR starts_with(text, 'P-')) a
    LEFT JOIN (SELECT * FROM rawfiles WHERE line_number > 1 AND NOT starts_with(text, 'P-')) b ON b.dataset_id = a.dataset_id AND b.line_number = a.line_number + 1"""
reg("src_delim", lambda r: reports.to_commas(checkpointed(reports.join_broken(checkpointed(r)))).select("dataset_id", "line_number", "text"), ["rawfiles"], f"""
    SELECT dataset_id, line_number, CASE WHEN {_K} NOT IN (1, 2) THEN text ELSE translate(CASE WHEN {_K} = 1 AND line_number > 1
      THEN regexp_replace(replace(replace(text, '"', ''), ';', '|'), '(-?[0-9]+,[0-9][0-9])', '"\\1"', 'g') ELSE replace(text, '"', '') END, '|;' || chr(9), ',,,') END AS text
    FROM ({_WHOLE})""")
reg("src_join_quoted", lambda r: reports.join_broken(checkpointed(r)).select("dataset_id", "line_number", "text"), ["rawfiles"], _WHOLE)


def plain_lines(r: DataFrame) -> DataFrame:
    """Numbered lines are written once and then read by every ingest step."""
    return checkpointed(reports.to_commas(checkpointed(reports.join_broken(checkpointed(r)))))


def _cells(r: DataFrame) -> DataFrame:
    x = plain_lines(r)
    return tables.with_cells(x, headers.headers(x))


reg("src_date_order", lambda r: tables.date_order(_cells(r)), ["rawfiles"],
    f"SELECT DISTINCT dataset_id, source_file, CASE {_K} WHEN 1 THEN 'day-first' WHEN 2 THEN 'month-first' ELSE 'iso' END AS date_order FROM rawfiles")
reg("src_decimal_style", lambda r: tables.decimal_style(_cells(r), ["invoice_amount", "paid_amount"]), ["rawfiles"],
    f"SELECT DISTINCT dataset_id, source_file, {_K} = 1 AS invoice_amount_comma, {_K} = 1 AS paid_amount_comma FROM rawfiles")
reg("src_header_norm", lambda r: headers.headers(plain_lines(r)).select("dataset_id", F.array_join("header", "|").alias("header")), ["rawfiles"],
    f"SELECT DISTINCT dataset_id, '{'|'.join(_COLS)}' AS header FROM rawfiles")


def _typed(r: DataFrame) -> DataFrame:
    x = plain_lines(r)
    t = tables.typed(x, headers.headers(x), "payments.csv")
    return t.select("dataset_id", "line_number", "pay_date", "invoice_date", F.regexp_replace("supplier", " ", "").alias("supplier"), "invoice_no",
                    F.col("invoice_amount").cast("double").alias("invoice_amount"), F.col("paid_amount").cast("double").alias("paid_amount"))


_PAID_VIEW = bridge.PAYMENTS.format(lineitem="lineitem", orders="orders")
reg("src_typed", _typed, ["rawfiles"], f"""
    SELECT dataset_id, line_number, pay_date, invoice_date, replace(supplier, ' ', '') AS supplier, invoice_no,
      CAST(CASE WHEN {_K} = 1 AND line_number % 22 = 0 THEN 1234 ELSE invoice_amount END AS DOUBLE) AS invoice_amount, CAST(paid_amount AS DOUBLE) AS paid_amount FROM ({_PAID_VIEW}) p""")


def _profile(r: DataFrame) -> DataFrame:
    return tables.profile(_cells(r), "payments.csv").select("dataset_id", "rows", "date_order", "invoice_amount_three_decimals", "invoice_amount_unreadable", "pay_date_unreadable", "reversals")


reg("profile", _profile, ["rawfiles"], f"""
    SELECT dataset_id, count(*) AS rows, any_value(CASE {_K} WHEN 1 THEN 'day-first' WHEN 2 THEN 'month-first' ELSE 'iso' END) AS date_order,
      count(*) FILTER ({_K} = 1 AND line_number % 22 = 0) AS invoice_amount_three_decimals, 0 AS invoice_amount_unreadable, 0 AS pay_date_unreadable, count(*) FILTER (paid_amount < 0) AS reversals
    FROM ({_PAID_VIEW}) p GROUP BY dataset_id""")

# ---------------------------------------------------------------- report-style exports
REPORTS = f"""
WITH p AS (SELECT *, (line_number - line_number % 200) / 200 AS ord FROM ({bridge.PAYMENTS}) WHERE line_number % 2 = 0),
d AS (SELECT DISTINCT dataset_id FROM p),
g AS (SELECT dataset_id, CAST(floor((line_number - 2) / 200) AS BIGINT) AS grp, sum(paid_amount) AS total FROM p GROUP BY dataset_id, CAST(floor((line_number - 2) / 200) AS BIGINT))
SELECT dataset_id, 'Bill Payment List.csv' AS source_file, CAST(n AS BIGINT) AS line_number, words AS text FROM d CROSS JOIN (
  SELECT 1 AS n, 'Acme Ltd' AS words UNION ALL SELECT 2, 'Bill Payment List' UNION ALL SELECT 3, 'From,09/01/2026,To,09/30/2026' UNION ALL SELECT 4, ',Date,Num,Memo,Open Balance,Amount') t
UNION ALL SELECT dataset_id, 'Bill Payment List.csv', grp * 1000 + 1000, 'Client ' || CAST(grp AS STRING) FROM g
UNION ALL SELECT dataset_id, 'Bill Payment List.csv', CAST(floor((line_number - 2) / 200) AS BIGINT) * 1000 + 1000 + (line_number - 2) % 200 + 1,
  ',' || CAST(pay_date AS STRING) || ',' || invoice_no || ',ok,' || CAST(invoice_amount AS STRING) || ',' || CAST(paid_amount AS STRING) FROM p
UNION ALL SELECT dataset_id, 'Bill Payment List.csv', grp * 1000 + 1900, 'Total Client ' || CAST(grp AS STRING) || ',,,,,' || CAST(total AS STRING) FROM g
UNION ALL SELECT dataset_id, 'Bill Payment List.csv', CAST(9000000000000 AS BIGINT), 'Printed on Thursday' FROM d"""
bridge.VIEWS["reports"] = REPORTS
reg("src_header_find", lambda r: reports.header_lines(checkpointed(r)), ["reports"], "SELECT DISTINCT dataset_id, source_file, CAST(4 AS BIGINT) AS header_line FROM reports")
reg("src_headings", lambda r: reports.classified(checkpointed(r)).select("dataset_id", "line_number", "kind", F.when(F.col("kind") == "row", F.col("under")).alias("under")), ["reports"], """
    SELECT dataset_id, line_number, CASE WHEN line_number < 4 THEN 'title' WHEN line_number = 4 THEN 'header' WHEN line_number = 9000000000000 THEN 'footer' WHEN line_number % 1000 = 0 THEN 'heading'
      WHEN line_number % 1000 = 900 THEN 'total' ELSE 'row' END AS kind,
      CASE WHEN line_number > 4 AND line_number < 9000000000000 AND line_number % 1000 NOT IN (0, 900) THEN 'Client ' || CAST(line_number // 1000 - 1 AS VARCHAR) END AS under FROM reports""")
reg("src_tidy", lambda r: reports.tidied(checkpointed(r)).select("dataset_id", "line_number", "text"), ["reports"], """
    SELECT dataset_id, line_number, CASE WHEN line_number = 4 THEN 'Vendor' ELSE 'Client ' || CAST(line_number // 1000 - 1 AS VARCHAR) END || text AS text FROM reports
    WHERE line_number = 4 OR (line_number > 4 AND line_number < 9000000000000 AND line_number % 1000 NOT IN (0, 900))""")

# bills with one row per item
ITEMS = """
SELECT 'D' || CAST(l_orderkey % 8 AS STRING) AS dataset_id, 'approvals.csv' AS source_file, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) + 1 AS line_number,
  'Bill ' || CAST(l_orderkey AS STRING) || ',' || CASE WHEN l_suppkey % 2 = 0 THEN 'North' ELSE ' South ' END || ',' || 'item ' || CAST(l_partkey AS STRING) || ',' || CAST(CAST(l_quantity AS INT) AS STRING) AS text FROM {lineitem}
UNION ALL SELECT DISTINCT 'D' || CAST(l_orderkey % 8 AS STRING), 'approvals.csv', CAST(1 AS BIGINT), '*BillNumber,Branch,Description,Quantity' FROM {lineitem}"""
bridge.VIEWS["items"] = ITEMS
reg("src_collapse_items", lambda r: reports.collapse_items(r).select("dataset_id", "line_number"), ["items"], """
    SELECT dataset_id, line_number FROM items WHERE line_number = 1
    UNION ALL SELECT dataset_id, min(line_number) AS line_number FROM items WHERE line_number > 1 GROUP BY dataset_id, split_part(text, ',', 1), trim(split_part(text, ',', 2))""")

# ---------------------------------------------------------------- headers of many files
_HEADS = {0: ("Bill Payment List.csv", "Payment No,Date Paid,Bill Date,Vendor,Bill No,Bill Amount,Amount Paid"), 1: ("export (3).csv", "Claim ID,Date,Employee,Category,Amount,Receipt,Notes,Attendees"),
          2: ("Chase1234.csv", "Date,Description,Amount,Balance"), 3: ("data.csv", "a,b,c"), 4: ("Contacts.csv", "*ContactName,TaxNumber,Status,Bank Updated"),
          5: ("Approved bills.csv", "RecordId,DocNo,Date,Vendor,Amount,RequestedBy,ApprovedBy,ApproverRole,PO #"), 6: ("list.csv", "Date,Name,Amount")}
HEADERS = ("SELECT 'C' || CAST(c_custkey AS STRING) AS dataset_id, CASE c_custkey % 7 " + " ".join(f"WHEN {k} THEN '{n}'" for k, (n, _) in _HEADS.items()) + " END AS source_file, CAST(1 AS BIGINT) AS line_number, CASE c_custkey % 7 "
           + " ".join(f"WHEN {k} THEN '{h}'" for k, (_, h) in _HEADS.items()) + " END AS text FROM {customer}")
bridge.VIEWS["file_headers"] = HEADERS


def _recognised(h: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return headers.recognised(headers.headers(h).select("dataset_id", "source_file", F.col("raw").alias("header"), none.alias("taken")))


_M = "CAST(substr(dataset_id, 2) AS BIGINT) % 7"
reg("src_guess", lambda h: _recognised(h).select("dataset_id", "kind", "share"), ["file_headers"], f"""
    SELECT dataset_id, CASE {_M} WHEN 0 THEN 'payments.csv' WHEN 1 THEN 'expenses.csv' WHEN 2 THEN 'bank_statement.csv' WHEN 4 THEN 'vendors.csv' WHEN 5 THEN 'approvals.csv' END AS kind,
      CASE {_M} WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 4 THEN 0.44 WHEN 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS share FROM file_headers""")
reg("src_explain", lambda h: _recognised(h).where("kind IS NULL").select("dataset_id", "why_not"), ["file_headers"], f"""
    SELECT dataset_id, CASE {_M} WHEN 3 THEN 'its columns do not look like any of the audit files' ELSE 'it may be bank_statement.csv, but it lacks a name that says so (or a balance column)' END AS why_not
    FROM file_headers WHERE {_M} IN (3, 6)""")


def _as_payments(h: DataFrame) -> DataFrame:
    """The same headers, all uploaded as payments.csv."""
    return headers.headers(h.withColumn("source_file", F.lit("payments.csv")))


reg("src_missing", lambda h: _as_payments(h).select("dataset_id", F.array_join(headers.missing(F.col("header"), F.col("source_file")), ",").alias("missing")), ["file_headers"],
    f"SELECT dataset_id, '{','.join(_COLS)}' AS missing FROM file_headers")
_PAY_MATCH = {"payment_id": "Payment No", "pay_date": "Date Paid", "invoice_date": "Bill Date", "supplier": "Vendor", "invoice_no": "Bill No", "invoice_amount": "Bill Amount", "paid_amount": "Amount Paid"}


def _suggested(h: DataFrame) -> DataFrame:
    x = _as_payments(h)
    return headers.suggested_columns(x.select("dataset_id", "source_file", headers.missing(F.col("raw"), F.col("source_file")).alias("missing"), F.col("raw").alias("header"))).drop("source_file")


reg("src_colmatch", _suggested, ["file_headers"], "WITH m(v, field, column_name) AS (VALUES " + ", ".join(f"(0, '{f}', '{c}')" for f, c in _PAY_MATCH.items())
    + ", (1, 'pay_date', 'Date'), (1, 'paid_amount', 'Amount'), (2, 'pay_date', 'Date'), (2, 'paid_amount', 'Amount'), (4, 'supplier', '*ContactName'), (5, 'invoice_no', 'DocNo'), (5, 'pay_date', 'Date'), (5, 'supplier', 'Vendor'), (5, 'paid_amount', 'Amount'),"
      " (6, 'pay_date', 'Date'), (6, 'supplier', 'Name'), (6, 'paid_amount', 'Amount'))"
    + f" SELECT dataset_id, field, column_name FROM file_headers JOIN m ON m.v = {_M}")
reg("src_colmatch_auto", lambda h: headers.auto_matched(_as_payments(h)).select("dataset_id", "checked", F.array_join("header", ",").alias("header")), ["file_headers"], f"""
    SELECT dataset_id, {_M} = 0 AS checked, CASE {_M} WHEN 0 THEN '{",".join(_COLS)}' WHEN 1 THEN 'claim_id,date,employee,category,amount,Receipt,notes,Attendees' WHEN 2 THEN 'date,description,amount,Balance'
      WHEN 4 THEN '*ContactName,TaxNumber,status,Bank Updated' WHEN 5 THEN 'RecordId,DocNo,date,vendor,amount,RequestedBy,ApprovedBy,ApproverRole,PO #' WHEN 6 THEN 'date,name,amount' ELSE 'a,b,c' END AS header FROM file_headers""")


def _presets(h: DataFrame) -> DataFrame:
    heads = _as_payments(h)
    saved = heads.where("raw[0] = 'Payment No'").groupBy(headers.signature(F.col("source_file"), F.col("raw")).alias("signature")).agg(F.first("raw").alias("raw"))
    pairs = F.map_from_arrays("raw", F.array(*[F.lit(c) for c in _COLS]))
    return headers.with_presets(heads, saved.select("signature", pairs.alias("renames"))).select("dataset_id", "preset", F.array_join("header", ",").alias("header"))


reg("src_presets", _presets, ["file_headers"], f"""
    SELECT dataset_id, {_M} = 0 AS preset, CASE {_M} WHEN 0 THEN '{",".join(_COLS)}' WHEN 1 THEN 'claim_id,date,employee,category,amount,Receipt,notes,Attendees' WHEN 2 THEN 'date,description,amount,Balance'
      WHEN 4 THEN '*ContactName,TaxNumber,status,Bank Updated' WHEN 5 THEN 'RecordId,DocNo,date,vendor,amount,RequestedBy,ApprovedBy,ApproverRole,PO #' WHEN 6 THEN 'date,name,amount' ELSE 'a,b,c' END AS header FROM file_headers""")


def _seen(h: DataFrame) -> DataFrame:
    heads = _as_payments(h)
    orders = heads.where("dataset_id LIKE '%7'").select("dataset_id", "source_file", F.lit("day-first").alias("date_order"))
    matching = _suggested(h).withColumn("source_file", F.lit("payments.csv")).where("field = 'paid_amount'")
    return headers.as_seen(heads, matching, orders).select("dataset_id", F.array_join("header", ",").alias("header"), "date_order")


reg("src_view", _seen, ["file_headers"], f"""
    SELECT dataset_id, CASE {_M} WHEN 0 THEN 'Payment No,Date Paid,Bill Date,vendor,Bill No,Bill Amount,paid_amount' WHEN 1 THEN 'claim_id,date,employee,category,amount,Receipt,notes,Attendees' WHEN 2 THEN 'date,description,amount,Balance'
      WHEN 4 THEN '*ContactName,TaxNumber,status,Bank Updated' WHEN 5 THEN 'RecordId,DocNo,date,vendor,amount,RequestedBy,ApprovedBy,ApproverRole,PO #' WHEN 6 THEN 'date,name,amount' ELSE 'a,b,c' END AS header,
      CASE WHEN dataset_id LIKE '%7' THEN 'day-first' END AS date_order FROM file_headers""")
reg("set_except", lambda h: _as_payments(h).select("dataset_id", F.array_join(F.array_except(F.array(*[F.lit(c) for c in _COLS + ["amount"]]), "header"), ",").alias("lacking")), ["file_headers"],
    f"SELECT dataset_id, CASE WHEN {_M} IN (1, 2, 5, 6) THEN '{','.join(_COLS)}' ELSE '{','.join(_COLS)},amount' END AS lacking FROM file_headers")

# ---------------------------------------------------------------- uploads and answer keys
UPLOADS = """
SELECT 'N' || CAST(c_nationkey AS STRING) AS dataset_id, u AS upload, 'vendors.csv' AS source_file, c_custkey AS line_number, c_name || CASE WHEN u = 3 THEN ' (changed)' ELSE '' END AS text
FROM {customer} CROSS JOIN (SELECT 1 AS u UNION ALL SELECT 2 UNION ALL SELECT 3) t"""
bridge.VIEWS["uploads"] = UPLOADS
reg("src_dataset_dedupe", lambda u: lines.labelled_uploads(lines.dataset_digest(u)), ["uploads"],
    "SELECT DISTINCT dataset_id, upload, CASE WHEN upload = 3 THEN dataset_id || ' (2)' ELSE dataset_id END AS label FROM uploads")


def _key_rows(k: DataFrame) -> DataFrame:
    """The answer key as text cells, some rows planted twice."""
    rel = F.when(F.col("related_line").isNull(), F.lit("")).otherwise(F.concat_ws(";", F.col("related_line").cast("string"), F.lit("x"), F.col("line_number").cast("string")))
    t = k.select("dataset_id", "id", "clause", "area", F.concat(F.lit(" "), "source_file").alias("source_file"), F.col("line_number").cast("string").alias("line_text"), rel.alias("related_lines"), "description",
                 F.when(F.col("expect") == "problem", "").otherwise(" Trap ").alias("expect"))
    return t.union(t.withColumn("id", F.concat("id", F.lit("-again"))))


reg("src_answer_key", lambda k: answer_key.from_rows(_key_rows(k)).select("dataset_id", "id", "source_file", "expect", F.array_join(F.transform("lines", lambda x: x.cast("string")), ";").alias("lines")), ["answer_key"], """
    WITH k AS (SELECT dataset_id, id, source_file, expect, CASE WHEN related_line IS NULL THEN CAST(line_number AS VARCHAR) ELSE CAST(least(line_number, related_line) AS VARCHAR) || ';' || CAST(greatest(line_number, related_line) AS VARCHAR) END AS lines FROM answer_key)
    SELECT dataset_id, min(id) AS id, source_file, expect, lines FROM k GROUP BY dataset_id, source_file, expect, lines""")
reg("src_key_from_findings", lambda f, n: answer_key.from_findings(f, n), ["findings", "lines"], """
    SELECT dataset_id, finding, line_number AS line FROM findings UNION
    SELECT f.dataset_id, f.finding, l.line_number FROM findings f JOIN lines l ON l.dataset_id = f.dataset_id AND l.source_file = f.source_file AND l.text = f.related_text""")
