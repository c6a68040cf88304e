"""Checks over contract text and scanned invoices."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof.functions import dates, money, text
from payproof.operators.findings import Found, finding, link
from payproof.operators.payments import word_prefixes
from payproof.sources.textfiles import invoice_blocks, records

CONTRACTS, INVOICES = "contracts.txt", "invoices.txt"

# --- fixed values: wording of contracts and of the lines billed against them --
EXCLUDED = r"(?i)surcharge.*excluded|not listed|may not be billed"
RATE_AGREED = r"(?i)rate is [$€£]?(\d{1,7}(?:\.\d{1,4})?)\s*(?:per|an|/)\s*(?:hour|hr)"
RATE_BILLED = r"(?i)(?:at|@)\s*[$€£]?(\d{1,7}(?:\.\d{1,4})?)\s*(?:per|an|/)\s*(?:hour|hr)"
HOURS = r"(?i)(?<![\d.])(\d{1,7}(?:\.\d{1,4})?)\s*(?:hours|hrs)\b"
AUTO_RENEWS, NO_NOTICE = r"(?i)auto-renews", r"(?i)no notice of cancellation"
ENDS_ON = r"(?i)ends on (\d{4}-\d{2}-\d{2})"
SERVICE = r"Service period (\d{4}-\d{2}-\d{2}) to (\d{4}-\d{2}-\d{2})"
AMOUNT_AT_END = r"(\d[\d,]{0,20}\.\d{2})\s*$"


def _agreed(lines: DataFrame) -> DataFrame:
    t = F.col("body")
    return (records(lines, "CONTRACT")
            .select("dataset_id", "vendor_key", F.col("line_number").alias("contract_line"), t.rlike(EXCLUDED).alias("excludes"),
                    F.regexp_extract(t, RATE_AGREED, 1).alias("agreed"), t.rlike(AUTO_RENEWS).alias("renews"),
                    F.try_to_date(F.regexp_extract(t, ENDS_ON, 1), "yyyy-M-d").alias("ends")))


def _billed(lines: DataFrame) -> DataFrame:
    t = F.col("body")
    return (records(lines, "INVOICE")
            .select("dataset_id", "vendor_key", "line_number", "ref", "vendor",
                    money.parse_amount(F.regexp_extract(t, AMOUNT_AT_END, 1)).alias("amount"),
                    F.contains(F.lower(t), F.lit("surcharge")).alias("surcharge"), F.regexp_extract(t, RATE_BILLED, 1).alias("billed"),
                    F.regexp_extract(t, HOURS, 1).alias("hours"), t.rlike(NO_NOTICE).alias("no_notice"),
                    F.try_to_date(F.regexp_extract(t, SERVICE, 2), "yyyy-M-d").alias("service_end")))


def _found(hit: DataFrame, clause: str, severity: str, amount: Column, title: Column) -> Found:
    return Found(finding(hit, "Contracts", clause, severity, amount, title, CONTRACTS, "line_number", F.col("contract_line")),
                 link(hit, clause, CONTRACTS, "line_number", "contract_line", F.col("contract_line")))


ON = ["dataset_id", "vendor_key"]


def excluded_charge(lines: DataFrame, limits: dict) -> Found:
    """7.1. Both sides are cut to the lines that matter before they meet, as in every contract check."""
    title = F.concat(F.col("ref"), F.lit(" adds a $"), money.fmt(F.col("amount")), F.lit(" charge the contract does not allow"))
    hit = _billed(lines).where("surcharge").withColumn("title", title).join(_agreed(lines).where("excludes"), ON)
    return _found(hit, "7.1", "Medium", F.col("amount"), F.col("title"))


def rate_above_contract(lines: DataFrame, limits: dict) -> Found:
    number = lambda c: F.col(c).cast("decimal(11,4)")
    said = F.concat(F.col("vendor"), F.lit(" billed "), F.col("billed"), F.lit(" per hour against a contracted "))
    billed = _billed(lines).where("billed <> '' AND hours <> ''").withColumns({"said": said, "billed_rate": number("billed"), "billed_hours": number("hours")})
    agreed = _agreed(lines).where("agreed <> ''").withColumn("agreed_rate", number("agreed"))
    hit = billed.join(agreed, ON).where("billed_rate > agreed_rate")
    return _found(hit, "7.2", "High", F.expr("bround((billed_rate - agreed_rate) * billed_hours, 2)"), F.concat("said", "agreed"))


def after_contract_end(lines: DataFrame, limits: dict) -> Found:
    hit = _billed(lines).where("service_end IS NOT NULL").join(_agreed(lines).where("ends IS NOT NULL"), ON).where("service_end > ends")
    return _found(hit, "7.3", "Medium", F.col("amount"), F.concat(F.col("vendor"), F.lit(" billed for service after the contract ended")))


def silent_renewal(lines: DataFrame, limits: dict) -> Found:
    title = F.concat(F.col("vendor"), F.lit(" auto-renewed with no cancellation decision on file"))
    hit = _billed(lines).where("no_notice").withColumn("title", title).join(_agreed(lines).where("renews"), ON)
    return _found(hit, "7.4", "Low", F.col("amount"), F.col("title"))


# ---------------------------------------------------------------- scanned invoices
def read_invoices(lines: DataFrame, vendors: DataFrame) -> DataFrame:
    """Invoice blocks that have a number, with the supplier as far as it can be told: the master record of an equal
    name, else the one master name that is a longer or shorter form of it."""
    b = (invoice_blocks(lines).where("number IS NOT NULL")
         .withColumn("said_vendor", F.coalesce("vendor", "guess", F.lit("")))
         .withColumn("name_key", text.norm_name(F.col("said_vendor"))).withColumn("inv_key", text.inv_key(F.col("number")))
         .withColumn("amount", F.when(F.col("total").isNotNull(), money.parse_amount(F.col("total"))).otherwise(F.lit(0).cast(money.MONEY))))
    master = (vendors.withColumn("key", text.norm_name(F.col("name"))).groupBy("dataset_id", "key")
              .agg(F.max(F.struct("line_number", "vendor_id", "bank_acct")).alias("m")))
    several = F.contains(F.col("key"), F.lit(" "))
    forms = (master.where("key <> ''").select("dataset_id", F.col("key").alias("form"), "key")
             .union(master.where(several).select("dataset_id", F.explode(word_prefixes("key")).alias("form"), "key")))
    asked = b.where("name_key <> ''").select("dataset_id", "name_key").distinct()
    # a master name meets an invoice name when one is the other, or a word prefix of it
    longer = asked.join(forms, (forms.dataset_id == asked.dataset_id) & (forms.form == asked.name_key)).select(asked.dataset_id, "name_key", "key")
    shorter = (asked.where(F.contains("name_key", F.lit(" "))).select("dataset_id", "name_key", F.explode(word_prefixes("name_key")).alias("key"))
               .join(master.where("key <> ''").select("dataset_id", "key"), ["dataset_id", "key"]).select("dataset_id", "name_key", "key"))
    fits = (longer.union(shorter).distinct().groupBy("dataset_id", "name_key")
            .agg(F.bool_or(F.col("key") == F.col("name_key")).alias("exact"), F.count("*").alias("n"), F.min("key").alias("only"))
            .select("dataset_id", "name_key", F.when(F.col("exact"), F.col("name_key")).when(F.col("n") == 1, F.col("only")).alias("key")))
    known = fits.where("key IS NOT NULL").join(master, ["dataset_id", "key"]).select("dataset_id", "name_key", "m.vendor_id", "m.bank_acct")
    return (b.join(known, ["dataset_id", "name_key"], "left")
            .withColumn("who", F.coalesce("vendor_id", F.when(F.col("vendor").isNotNull(), text.norm_name(F.col("vendor"))), F.lit(""))))


def not_approved(lines: DataFrame, vendors: DataFrame, approvals: DataFrame, limits: dict) -> Found:
    """8.1: no approval record, or a total that differs from it; the supplier's own record counts before another's."""
    inv = read_invoices(lines, vendors)
    a = approvals.where(text.is_invoice_type(F.col("type"))).withColumn("inv_key", text.inv_key(F.col("doc_no"))) \
        .withColumn("name_key", text.norm_name(F.col("vendor")))
    rec = F.struct("line_number", "amount")
    own = a.groupBy("dataset_id", "inv_key", "name_key").agg(F.min(rec).alias("own"))
    first = a.groupBy("dataset_id", "inv_key").agg(F.min(rec).alias("first"))
    have = a.groupBy("dataset_id").agg(F.lit(True).alias("have"))
    x = (inv.join(own, ["dataset_id", "inv_key", "name_key"], "left").join(first, ["dataset_id", "inv_key"], "left")
         .join(have, "dataset_id").withColumn("approved", F.coalesce("own", "first").getField("amount")))
    off = F.abs(F.col("amount") - F.col("approved"))
    none = F.col("approved").isNull()
    hit = x.where(none | (F.col("total").isNotNull() & (off > F.lit(0.005).cast("decimal(4,3)"))))
    title = F.when(none, F.concat(F.lit("Invoice "), F.col("number"), F.lit(" ("), F.col("name"), F.lit(") has no approval record"))) \
        .otherwise(F.concat(F.lit("Invoice "), F.col("number"), F.lit(" total $"), money.fmt(F.col("amount")),
                            F.lit(" differs from the approved $"), money.fmt(F.col("approved"))))
    line = F.when(none, F.col("number_line")).otherwise(F.col("total_line"))
    return Found(finding(hit, "Invoices", "8.1", "Medium", F.when(none, F.col("amount")).otherwise(F.bround(off, 2)), title, INVOICES, line),
                 link(hit.where(~none), "8.1", INVOICES, "total_line", "number_line"))


def other_account(lines: DataFrame, vendors: DataFrame, limits: dict) -> Found:
    """8.2: the account an invoice asks to be paid to is not the one on file."""
    on_file = F.right(F.regexp_replace("bank_acct", r"\D", ""), F.lit(4))
    asked = F.right("bank", F.lit(4))
    hit = read_invoices(lines, vendors).where(F.col("bank").isNotNull() & F.col("vendor_id").isNotNull()) \
        .withColumn("on_file", on_file).withColumn("asked", asked).where("on_file <> '' AND on_file <> asked")
    title = F.concat(F.lit("Invoice "), F.col("number"), F.lit(" asks for payment to account ending "), F.col("asked"), F.lit("; "),
                     F.col("vendor_id"), F.lit(" is on file with "), F.col("on_file"))
    return Found(finding(hit, "Invoices", "8.2", "High", F.col("amount"), title, INVOICES, "bank_line"),
                 link(hit, "8.2", INVOICES, "bank_line", "number_line"))


def submitted_again(lines: DataFrame, vendors: DataFrame, limits: dict) -> Found:
    """8.3: the number came before, unless both suppliers are known and differ. The first line of each number, and of
    each number and supplier, is all a later copy needs to meet."""
    inv = read_invoices(lines, vendors)
    key = ["dataset_id", "inv_key"]
    by_who = inv.groupBy(*key, "who").agg(F.min("number_line").alias("same_who"))
    by_key = inv.groupBy(*key).agg(F.min("number_line").alias("anyone"),
                                   F.min(F.when(F.col("who") == "", F.col("number_line"))).alias("unknown"))
    x = inv.join(by_who, [*key, "who"]).join(by_key, key)
    earlier = F.when(F.col("who") == "", F.col("anyone")).otherwise(F.least("same_who", "unknown"))
    hit = x.withColumn("earlier", earlier).where("earlier < number_line")
    title = F.concat(F.lit("Invoice "), F.col("number"), F.lit(" was submitted twice ("), F.col("name"), F.lit(")"))
    return Found(finding(hit, "Invoices", "8.3", "High", F.col("amount"), title, INVOICES, "number_line"),
                 link(hit, "8.3", INVOICES, "number_line", "earlier"))
