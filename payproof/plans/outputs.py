"""Reports and feeds, and the recurring check, as registered queries."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.operators import expenses, payments, vendors
from payproof.operators.findings import union
from payproof.plans import bridge
from payproof.plans import checks, gates  # noqa: F401  (their oracles are used below)
from payproof.plans.audit import Files, analyze
from payproof.plans.registry import all_of, o_fmt, register, with_views
from payproof.plans.reviews import SHADOW, reg
from payproof.operators import evidence, review
from payproof.scale import checkpointed, shared_folder
from payproof.sources import headers, lines
from payproof.streaming import folder

L = S.LIMITS


def _findings_of(p: DataFrame, v: DataFrame, e: DataFrame) -> DataFrame:
    return union([payments.no_reference(p, L).findings, payments.weekend_release(p, L).findings, vendors.no_tax_form(v, L).findings,
                  expenses.no_receipt(e, L).findings, expenses.personal_item(e, L).findings])


def _known(f: DataFrame) -> DataFrame:
    """Findings an earlier run reported: those on even lines."""
    return folder.fingerprints(f.where("line_number % 2 = 0")).select("dataset_id", "fingerprint")


def _report(p: DataFrame, v: DataFrame, e: DataFrame) -> DataFrame:
    f = _findings_of(p, v, e)
    evidence = p.select("dataset_id", "source_file", "line_number", "text").union(v.select("dataset_id", "source_file", "line_number", "text")) \
        .union(e.select("dataset_id", "source_file", "line_number", "text"))
    return folder.report_rows(f, evidence, _known(f))


_V = ["payments", "vendors", "expenses"]
#: The checks of `audit.analyze` over all kinds of file but the bank statement, whose two have queries of their own.
CHECKS = ["chk_5_2", "chk_5_1", "chk_5_3_noref", "chk_5_3_early", "chk_5_4", "chk_5_6", "chk_4_1_cross", "chk_4_1_unknown", "chk_1_2", "chk_1_1_nopo", "chk_1_1_late", "chk_1_3", "chk_1_6", "chk_1_4",
          "chk_4_3", "chk_4_1_vendor", "chk_4_4", "chk_4_5", "chk_4_2", "chk_6_1", "chk_6_2", "chk_6_3", "chk_6_5", "chk_6_4", "chk_6_6", "chk_7_1", "chk_7_2", "chk_7_3", "chk_7_4", "chk_8_1", "chk_8_2", "chk_8_3"]


def _whole_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = {n: bridge.view(spark, sf_dir, n) for n in ("payments", "approvals", "vendors", "expenses", "contract_lines", "invoice_lines")}
    found = analyze(Files(payments=view["payments"], approvals=view["approvals"], vendors=view["vendors"], expenses=view["expenses"], contracts=view["contract_lines"], invoices=view["invoice_lines"]))
    return found.findings.groupBy("dataset_id", "clause").agg(F.count("*").alias("findings"), F.sum(F.col("line_number")).alias("lines"))


_EVERY_VIEW, _EVERY = all_of([c for c in CHECKS if c != "chk_5_6"], "dataset_id, clause, line_number", checks.NEAR_WHOLE)       # of 5.6 with all neighbours
register("set_union_checks", _whole_audit, with_views(_EVERY_VIEW, f"SELECT dataset_id, clause, count(*) AS findings, CAST(sum(line_number) AS BIGINT) AS lines FROM ({_EVERY}) GROUP BY ALL"))
_REPORTED = ["chk_5_3_noref", "chk_5_4", "chk_4_4", "chk_6_2", "chk_6_3"]
_REPORT = f"""
  f AS MATERIALIZED ({all_of(_REPORTED, "dataset_id, clause, severity, amount, title, source_file, line_number")[1]}),
  known AS (SELECT DISTINCT dataset_id, clause, source_file, title FROM f WHERE line_number % 2 = 0),
  report AS MATERIALIZED (SELECT f.*, CASE WHEN k.clause IS NULL THEN 'yes' ELSE '' END AS new FROM f LEFT JOIN known k USING (dataset_id, clause, source_file, title))"""
reg("snk_findings", lambda p, v, e: _report(p, v, e).select("dataset_id", "new", "severity", "clause", F.col("amount").cast("double").alias("amount"), "title", "line_number", "evidence"), _V, f"""
    WITH {_REPORT}, texts AS (SELECT dataset_id, source_file, line_number, text FROM payments UNION ALL SELECT dataset_id, source_file, line_number, text FROM vendors
      UNION ALL SELECT dataset_id, source_file, line_number, text FROM expenses)
    SELECT dataset_id, new, severity, clause, round(amount, 2) AS amount, title, line_number, text AS evidence FROM report JOIN texts USING (dataset_id, source_file, line_number)""")


def _alerts(p: DataFrame, v: DataFrame, e: DataFrame, h: DataFrame) -> DataFrame:
    heads = headers.auto_matched(headers.headers(h.withColumn("source_file", F.lit("payments.csv"))))
    return folder.alert_feed(_report(p, v, e), folder.data_problems(heads)).select("dataset_id", "new_findings", "high", "problems")


reg("snk_alert_feed", _alerts, [*_V, "file_headers"], f"""
    WITH {_REPORT} SELECT dataset_id, count(*) AS new_findings, count(*) FILTER (severity = 'High') AS high, 0 AS problems FROM report WHERE new = 'yes' GROUP BY dataset_id
    UNION ALL SELECT dataset_id, 0, 0, 1 FROM file_headers WHERE CAST(substr(dataset_id, 2) AS BIGINT) % 7 <> 0""")


def _problems(h: DataFrame) -> DataFrame:
    heads = headers.auto_matched(headers.headers(h.withColumn("source_file", F.lit("payments.csv"))))
    return folder.data_problems(heads).groupBy("note").agg(F.count("*").alias("files"))


reg("snk_problems", _problems, ["file_headers"], """
    SELECT 'payments.csv is missing columns: ' || CASE CAST(substr(dataset_id, 2) AS BIGINT) % 7 WHEN 1 THEN 'payment_id, invoice_date, supplier, invoice_no, invoice_amount' WHEN 2 THEN 'payment_id, invoice_date, supplier, invoice_no, invoice_amount'
      WHEN 3 THEN 'payment_id, pay_date, invoice_date, supplier, invoice_no, invoice_amount, paid_amount' WHEN 4 THEN 'payment_id, pay_date, invoice_date, invoice_no, invoice_amount, paid_amount'
      WHEN 5 THEN 'payment_id, invoice_date, invoice_amount' ELSE 'payment_id, invoice_date, invoice_no, invoice_amount' END || ' - it was not checked' AS note, count(*) AS files
    FROM file_headers WHERE CAST(substr(dataset_id, 2) AS BIGINT) % 7 <> 0 GROUP BY 1""")


def _top_alerts(p: DataFrame, v: DataFrame, e: DataFrame) -> DataFrame:
    return folder.first_new(_report(p, v, e), 10).select("dataset_id", "place", "clause", "line_number")


reg("topk_alert", _top_alerts, _V, f"""
    WITH {_REPORT} SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY CASE severity WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, source_file, line_number, clause) AS place, clause, line_number
    FROM report WHERE new = 'yes' QUALIFY place <= 10""")
reg("snk_workbook_tables", lambda f, d, n: review.with_decisions(f, d, SHADOW, evidence.warned(f, n))
    .groupBy("dataset_id", "decision").agg(F.count("*").alias("findings")), ["findings", "decisions", "lines"], f"""
    SELECT f.dataset_id, CASE WHEN f.clause IN ({', '.join(repr(c) for c in SHADOW)}) THEN 'Shadow (not in review)' ELSE coalesce(d.status, 'Pending') END AS decision, count(*) AS findings
    FROM findings f LEFT JOIN decisions d ON d.dataset_id = f.dataset_id AND d.finding = f.finding GROUP BY ALL""")


# ---------------------------------------------------------------- the recurring check, over files written from the views
_SENT = {"expenses": bridge._EXP_COLS, "vendors": bridge._VEN_COLS, "approvals": bridge._APP_COLS, "payment_run": bridge._RUN_COLS}     # nobody sends payments: the gate says so
_WATCHED_AREAS = ["Expenses", "Vendors"]                # and the payment gate; tests/test_ingest.py has other files
_LATE = ("D6", "D7")                                    # their expense claims come in a second run
_RUNS: dict[tuple[str, str], str] = {}


def _send(spark: SparkSession, sf_dir: str, to: str, late: bool) -> None:
    """Write the views as the files of a folder, each saved in parts whose names follow its lines."""
    files = []
    for kind in ["expenses"] if late else _SENT:
        body = bridge.view(spark, sf_dir, kind).select("dataset_id", "line_number", "text")
        first = body.select("dataset_id").distinct().select("dataset_id", F.lit(-1).cast("long").alias("line_number"), F.lit(",".join(_SENT[kind])).alias("text"))
        here = F.col("dataset_id").isin(*_LATE) == F.lit(late) if kind == "expenses" else F.lit(True)
        files.append(first.unionByName(body).where(here).select(F.col("dataset_id").alias("dataset"), F.lit(f"{kind}.csv").alias("kind"), "line_number", "text"))
    rows = checkpointed(union(files)).repartitionByRange("dataset", "kind", "line_number").sortWithinPartitions("dataset", "kind", "line_number")
    rows.select("dataset", "kind", "text").write.mode("append").partitionBy("dataset", "kind").text(to)


def _watched(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the reports after two runs of the scheduled job: all files but the late ones, then those. Worked once a
    session; the queries below show parts of it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        out = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
        for late in (False, True):
            _send(spark, sf_dir, f"{out}/in", late)
            folder.watch(spark, f"{out}/in", f"{out}/reports", [f"{k}.csv" for k in _SENT], lambda feed: None, _WATCHED_AREAS).awaitTermination()
        _RUNS.clear()
        _RUNS[key] = f"{out}/reports"
    return _RUNS[key]


def _csv_of(spark: SparkSession, out: str, name: str) -> DataFrame:
    x = spark.read.option("header", True).csv(f"{out}/{name}")
    return x.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in x.dtypes])


def _state(spark: SparkSession, out: str) -> DataFrame:
    datasets = _csv_of(spark, out, "findings").select("dataset_id").distinct()
    return folder.state_before(spark, f"{out}/state", datasets, 2).where("fingerprint IS NOT NULL").groupBy("dataset_id").agg(F.count("*").alias("fingerprints"))


def watched(name: str, show, sql: str) -> None:
    register(name, lambda spark, sf_dir: show(spark, _watched(spark, sf_dir)), with_views(_WATCH_VIEWS, f"WITH {_TWO_RUNS} {sql}"))


_WATCH_CHECKS = [f"chk_{c}" for c in ("6_1", "6_2", "6_3", "6_4", "6_5", "6_6", "4_3", "4_1_vendor", "4_4", "4_5", "4_2")]
_HIT_VIEWS, _HITS = all_of(_WATCH_CHECKS, "dataset_id, clause, severity, amount, title, source_file, line_number")
_HELD = gates._GATE.replace("FROM payments WHERE", "FROM payments WHERE false AND") + """
  SELECT dataset_id, supplier, invoice, CAST(amount AS DOUBLE) AS amount, reason || ' (not checked: no payments.csv)' AS reason FROM decided WHERE decision = 'HOLD'"""
_WATCH_VIEWS = sorted({*_HIT_VIEWS, *gates.VIEWS})
_IS_LATE = f"dataset_id IN {_LATE}"
_TWO_RUNS = f"""
  placed AS (SELECT dataset_id, source_file, line_number, 1 + row_number() OVER (PARTITION BY dataset_id, source_file ORDER BY line_number) AS file_line
    FROM (SELECT dataset_id, source_file, line_number FROM expenses UNION ALL SELECT dataset_id, source_file, line_number FROM vendors)),
  hits AS MATERIALIZED (SELECT h.*, file_line FROM ({_HITS}) h JOIN placed USING (dataset_id, source_file, line_number)),
  report AS MATERIALIZED (SELECT 0 AS batch, 'yes' AS new, * FROM hits WHERE NOT ({_IS_LATE} AND source_file = 'expenses.csv')
    UNION ALL SELECT 1, CASE source_file WHEN 'expenses.csv' THEN 'yes' ELSE '' END, * FROM hits WHERE {_IS_LATE}),
  held AS MATERIALIZED ({_HELD}),
  holds AS MATERIALIZED (SELECT 0 AS batch, * FROM held UNION ALL SELECT 1, * FROM held WHERE {_IS_LATE})"""
watched("str_folder", lambda spark, out: _csv_of(spark, out, "findings").select("batch", "dataset_id", "new", "severity", "clause", F.col("line_number").cast("bigint").alias("line_number"), F.col("amount").cast("double").alias("amount")),
        "SELECT batch, dataset_id, new, severity, clause, file_line AS line_number, round(amount, 2) AS amount FROM report")
watched("str_holds", lambda spark, out: _csv_of(spark, out, "holds").select("batch", "dataset_id", "supplier", "invoice", F.col("amount").cast("double").alias("amount"), "reason"), "SELECT * FROM holds")
watched("str_alerts", lambda spark, out: spark.read.parquet(f"{out}/alerts").select("batch", "dataset_id", "new_findings", "high", "held", "problems"), """
    SELECT batch, dataset_id, coalesce(new_findings, 0) AS new_findings, coalesce(high, 0) AS high, coalesce(held, 0) AS held, 0 AS problems
    FROM (SELECT batch, dataset_id, count(*) AS new_findings, count(*) FILTER (severity = 'High') AS high FROM report WHERE new = 'yes' GROUP BY ALL)
    FULL JOIN (SELECT batch, dataset_id, count(*) AS held FROM holds GROUP BY ALL) USING (batch, dataset_id)""")
watched("str_state", lambda spark, out: _csv_of(spark, out, "findings").groupBy("batch", "new").agg(F.count("*").alias("findings")),
        "SELECT batch, new, count(*) AS findings FROM report GROUP BY ALL")
watched("snk_state", _state, "SELECT dataset_id, count(DISTINCT (clause, source_file, title)) AS fingerprints FROM hits GROUP BY dataset_id")


def _folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables found in the folder, the kind their names say and their rows, counted in one read of all files' footers."""
    def name(path: str) -> Column:
        return F.regexp_extract(lines.file_of(F.col(path)), r"([^/]*)$", 1).alias("file")
    tables = {"pathGlobFilter": "*.parquet", "recursiveFileLookup": "true"}
    found = spark.read.format("binaryFile").options(**tables).load(sf_dir).select(name("path")).distinct()
    counted = spark.read.schema("absent int").options(**tables).parquet(sf_dir).groupBy(name("_metadata.file_path")).agg(F.count("*").alias("rows"))
    return found.join(counted, "file", "left").select("file", lines.kind_of(F.col("file")).alias("kind"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))


register("src_folder", _folder_files, " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, CAST(NULL AS VARCHAR) AS kind, count(*) AS rows FROM {t}" for t in bridge.TABLES))
