import sys
from datetime import date, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


PAYMENT = ("dataset_id string, source_file string, line_number long, text string, payment_id string, pay_date date, invoice_date date, vendor_id string, "
           "supplier string, invoice_no string, invoice_amount decimal(18,4), invoice_amount_blank boolean, paid_amount decimal(18,4)")
APPROVAL = ("dataset_id string, source_file string, line_number long, text string, record_id string, type string, doc_no string, date date, vendor string, "
            "amount decimal(18,4), requested_by string, approved_by string, approver_role string, po_no string")
EXPENSE = ("dataset_id string, source_file string, line_number long, text string, claim_id string, date date, employee string, category string, "
           "amount decimal(18,4), receipt_ref string, notes string, people string")
BANK = "dataset_id string, source_file string, line_number long, date date, description string, amount decimal(18,4), amount_text string, reference string"
DAY0 = date(2026, 9, 1)


def day(n):
    return None if n is None else DAY0 + timedelta(days=n)


def D(x):
    return Decimal(str(x)).quantize(Decimal("0.0001"))


def payment(line, inv, paid, billed="100", pay=0, inv_day=0, vendor="V-1", supplier="Ashby Components", dataset="A"):
    blank = billed == ""
    return (dataset, "payments.csv", line, f"row {line}", f"P-{line}", day(pay), day(inv_day), vendor, supplier, inv, D(0 if blank else billed), blank, D(paid))


def approval(line, amount, kind="INVOICE", doc=None, on=0, vendor="Ashby Components", by="Kate Lowe", ok_by="Mei Chen", role="Manager", po="", dataset="A"):
    return (dataset, "approvals.csv", line, f"row {line}", f"R-{line}", kind, doc or f"DOC-{line}", day(on), vendor, D(amount), by, ok_by, role, po)


def claim(line, amount, on=0, who="Kate Lowe", category="Parking", receipt="", notes="", people="", dataset="A"):
    return (dataset, "expenses.csv", line, f"row {line}", f"C-{line}", day(on), who, category, D(amount), receipt, notes, people)


def bank_line(line, amount, on=0, description="Payment", reference="", dataset="A"):
    return (dataset, "bank_statement.csv", line, day(on), description, D(amount), str(amount), reference)


def lines_of(found):
    return sorted((r["clause"], r["line_number"]) for r in found.findings.collect())
