"""Checks over the vendor master."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.functions import money, screens, text
from payproof.operators.findings import Found, finding, link

FILE = "vendors.csv"


def status() -> Column:
    return text.upper_strip(F.col("status"))


def active() -> Column:
    return (status() == "") | status().startswith("ACTIVE")


def paid_once() -> Column:
    return ~text.is_blank(F.col("last_paid_on"))


def paid_text() -> Column:
    return F.when(F.col("last_paid_amount") != 0, F.concat(F.lit("$"), money.fmt(F.col("last_paid_amount")), F.lit(" "))).otherwise("")


def bank_changed(vendors: DataFrame, limits: dict) -> Found:
    """4.3: anything but a clear yes is unverified; a new vendor's first account is no change."""
    changed = text.strip(F.col("bank_changed_on"))
    hit = vendors.where((changed != "") & ~text.upper_strip(F.col("bank_verified")).isin(S.YES)
                        & (changed != text.strip(F.col("created_on"))))
    before = F.coalesce(F.col("last_paid_date") < F.col("bank_changed_date"), F.lit(False))
    paid = paid_once() & ~before
    title = F.when(paid, F.concat(F.col("vendor_id"), F.lit(" paid to an unverified new bank account"))) \
        .otherwise(F.concat(F.col("vendor_id"), F.lit(" changed bank account on "), changed,
                            F.lit(" with no verification; the next payment would go to it")))
    return Found(finding(hit, "Vendors", "4.3", F.when(paid, "High").otherwise("Medium"),
                         F.when(paid, F.col("last_paid_amount")).otherwise(F.lit(0)), title, FILE))


def inactive_paid(vendors: DataFrame, limits: dict) -> Found:
    closed_after = F.coalesce(F.col("last_paid_date") <= F.col("status_changed_date"), F.lit(False))
    hit = vendors.where(~active() & paid_once() & ~closed_after)
    title = F.concat(F.initcap("status"), F.lit(" vendor "), F.col("vendor_id"), F.lit(" was paid "), paid_text(),
                     F.lit("on "), F.col("last_paid_on"))
    return Found(finding(hit, "Vendors", "4.1", "Medium", F.col("last_paid_amount"), title, FILE))


def no_tax_form(vendors: DataFrame, limits: dict) -> Found:
    """4.4; a blank counts only in a file that records tax forms at all."""
    form = text.upper_strip(F.col("w9_on_file"))
    used = vendors.groupBy("dataset_id").agg(F.bool_or(form != "").alias("tracked"))
    hit = vendors.where(paid_once() & (form.isin(S.NO) | (form == ""))).join(used, "dataset_id") \
        .where(form.isin(S.NO) | F.col("tracked"))
    title = F.concat(F.col("vendor_id"), F.lit(" paid "), paid_text(), F.lit("with no tax form on file"))
    return Found(finding(hit, "Vendors", "4.4", "Low", F.col("last_paid_amount"), title, FILE))


def import_dates(vendors: DataFrame) -> DataFrame:
    """Set-up dates shared by so many vendors that they are the day the list was imported."""
    total = vendors.groupBy("dataset_id").agg(F.count("*").alias("vendors"))
    return (vendors.where("created_date IS NOT NULL").groupBy("dataset_id", "created_date").agg(F.count("*").alias("n"))
            .join(total, "dataset_id").where("n >= 5 AND n * 10 >= vendors * 3"))


def new_vendor_paid(vendors: DataFrame, limits: dict) -> Found:
    age = F.date_diff(F.col("last_paid_date"), F.col("created_date"))
    hit = (vendors.where(age.between(0, limits["new_vendor_days"]) & active()
                         & (F.col("last_paid_amount") > F.lit(limits["director_limit"])))
           .join(import_dates(vendors).select("dataset_id", "created_date"), ["dataset_id", "created_date"], "left_anti"))
    title = F.concat(F.col("vendor_id"), F.lit(" was paid $"), money.fmt(F.col("last_paid_amount")), F.lit(" "), age,
                     F.lit(" days after it was set up"))
    return Found(finding(hit, "Vendors", "4.5", "Medium", F.col("last_paid_amount"), title, FILE))


def shared_tax_id(vendors: DataFrame, limits: dict) -> Found:
    """4.2: every later record with the tax id of an earlier one; remit-to records and placeholder ids do not count."""
    tax = F.regexp_replace(F.lower("tax_id"), "[^0-9a-z]", "")
    rows = (vendors.withColumn("tax", tax)
            .where((F.length("tax") >= 4) & ~F.col("tax").isin(S.PLACEHOLDER_TAX_IDS) & ~F.col("tax").rlike("^0+$")
                   & ~F.col("name").rlike(screens.REMIT_TO)))
    first = rows.groupBy("dataset_id", "tax").agg(F.min(F.struct("line_number", "vendor_id", "last_paid_amount")).alias("o"))
    hit = rows.join(first, ["dataset_id", "tax"]).where("line_number > o.line_number")
    title = F.concat(F.lit("Vendor records "), F.col("o.vendor_id"), F.lit(" and "), F.col("vendor_id"),
                     F.lit(" share tax ID "), text.strip(F.col("tax_id")))
    return Found(finding(hit, "Vendors", "4.2", "High", F.col("last_paid_amount") + F.col("o.last_paid_amount"), title, FILE),
                 link(hit, "4.2", FILE, "line_number", "o.line_number"))
