"""Hold or release: eight checks for every line of a proposed payment run.

Everything a line is compared with is first reduced to one row per (invoice key, vendor id) or (invoice key, vendor
name); a line then meets those rows by equality, never the raw payments, approvals or other run lines.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.functions import text
from payproof.scale import checkpointed, facts

CHECKS = range(1, 9)
LINE = ["dataset_id", "line_number"]


def present(df: DataFrame, flag: str) -> DataFrame:
    """Datasets that have this file; with it missing, the checks that need it pass and the reason says so."""
    return df.groupBy("dataset_id").agg(F.lit(True).alias(flag))


def resolve_vendor(run: DataFrame, vendors: DataFrame) -> DataFrame:
    """The vendor of each run line: by id, else by a name that fits exactly one. The last record of an id counts."""
    v = (vendors.withColumn("vid", text.upper_strip(F.col("vendor_id"))).groupBy("dataset_id", "vid")
         .agg(F.min("line_number").alias("first_line"),
              F.max(F.struct("line_number", "vendor_id", "name", "status", "bank_acct", "bank_changed_on", "bank_verified", "created_on")).alias("v"))
         .withColumn("v_name", text.norm_name(F.col("v.name"))))
    # a blank name is nobody's
    named = (v.where("v_name <> ''").groupBy("dataset_id", "v_name")
             .agg(F.count("*").alias("fits"), F.min("vid").alias("named_id"),
                  F.array_sort(F.collect_list(F.struct("first_line", "v.vendor_id"))).alias("ids"))
             .select("dataset_id", F.col("v_name").alias("sup"), "fits", "named_id",
                     F.array_join(F.transform("ids", lambda x: x["vendor_id"]), ", ").alias("fit_ids")))
    r = (run.withColumn("sup", text.norm_name(F.col("supplier"))).withColumn("run_id", text.upper_strip(F.col("vendor_id")))
         .join(named, ["dataset_id", "sup"], "left"))
    by_name = (F.col("run_id") == "") & (F.col("sup") != "")
    r = r.withColumn("vid", F.when(F.col("run_id") != "", F.col("run_id")).when(by_name & (F.col("fits") == 1), F.col("named_id")))
    r = r.join(v.drop("first_line"), ["dataset_id", "vid"], "left")
    return r.select(*run.columns, "sup", "v", "v_name", F.coalesce("vid", F.lit("")).alias("vid"),
                    F.when(by_name & (F.col("fits") > 1), F.col("fits")).alias("fits"), "fit_ids",
                    (F.col("v").isNotNull() & (F.col("run_id") != "") & (F.col("v_name") != F.col("sup"))).alias("name_differs"))


def with_names(lines: DataFrame) -> DataFrame:
    """One row per line and name it may go by (the supplier as written, and the master's name)."""
    names = F.array_compact(F.array_distinct(F.array("sup", "v_name")))
    return lines.select(*LINE, "key", "has_invoice", "vid", F.explode(names).alias("name"))


def _asked(lines: DataFrame) -> DataFrame:
    """The invoices of the run: of the long tables only their records are grouped."""
    return lines.where("has_invoice").select("dataset_id", "key").distinct()


def approval_for(lines: DataFrame, approvals: DataFrame) -> DataFrame:
    """Each line's approval record: its vendor's latest approved one, else its vendor's last, else the first there is."""
    rec = F.struct("line_number", "vendor_key", "amount", "approved_by")
    a = (approvals.where(text.is_invoice_type(F.col("type")) & ~text.is_blank(F.col("doc_no")))
         .withColumn("key", text.inv_key(F.col("doc_no"))).join(_asked(lines), ["dataset_id", "key"], "left_semi").withColumn("vendor_key", text.norm_name(F.col("vendor"))))
    own = checkpointed(a.groupBy("dataset_id", "key", F.col("vendor_key").alias("name"))
                       .agg(F.max(F.when(~text.is_blank(F.col("approved_by")), rec)).alias("approved"), F.max(rec).alias("latest"), F.min(rec).alias("first")))
    any_ = own.groupBy("dataset_id", "key").agg(F.min("first").alias("first"))
    own = own.drop("first")
    mine = (with_names(lines).where("has_invoice").join(own, ["dataset_id", "key", "name"])
            .groupBy(*LINE).agg(F.max("approved").alias("approved"), F.max("latest").alias("latest")))
    return (lines.select(*LINE, "key", "has_invoice").where("has_invoice").join(any_, ["dataset_id", "key"]).join(mine, LINE, "left")
            .select(*LINE, F.coalesce("approved", "latest", "first").alias("a")))


def already_paid(lines: DataFrame, payments: DataFrame) -> DataFrame:
    """Lines whose invoice a payment to the same vendor already names: by id when both have one, else by name."""
    p = (payments.where(~text.is_blank(F.col("invoice_no")))
         .select("dataset_id", text.inv_key(F.col("invoice_no")).alias("key"), text.upper_strip(F.col("vendor_id")).alias("pid"), "supplier")
         .join(_asked(lines), ["dataset_id", "key"], "left_semi"))
    p = checkpointed(p.withColumn("name", text.norm_name(F.col("supplier"))).drop("supplier"))
    ids = p.where("pid <> ''").select("dataset_id", "key", F.col("pid").alias("vid")).distinct()
    names = p.groupBy("dataset_id", "key", "name").agg(F.bool_or(F.col("pid") == "").alias("no_id"))
    by_id = lines.where("has_invoice AND vid <> ''").join(ids, ["dataset_id", "key", "vid"], "left_semi").select(*LINE)
    by_name = (with_names(lines).where("has_invoice").join(names, ["dataset_id", "key", "name"])
               .where("vid = '' OR no_id").select(*LINE))
    return by_id.union(by_name).distinct()


def earlier_in_run(lines: DataFrame) -> DataFrame:
    """Lines whose invoice an earlier line of the run already pays to the same vendor."""
    ids = lines.where("vid <> ''").groupBy("dataset_id", "key", "vid").agg(F.min("line_number").alias("first"))
    named = with_names(lines)
    names = named.groupBy("dataset_id", "key", "name").agg(
        F.min("line_number").alias("first"), F.min(F.when(F.col("vid") == "", F.col("line_number"))).alias("first_no_id"))
    by_id = lines.join(ids, ["dataset_id", "key", "vid"]).where("line_number > first").select(*LINE)
    by_name = (named.join(names, ["dataset_id", "key", "name"])
               .where("line_number > CASE WHEN vid = '' THEN first ELSE first_no_id END").select(*LINE))
    return by_id.union(by_name).distinct()


def distinct_labels(run: DataFrame) -> Column:
    return F.when(text.is_blank(F.col("line")), (F.col("line_number") - 1).cast("string")).otherwise(text.strip(F.col("line")))


def evaluate(run: DataFrame, vendors: DataFrame, approvals: DataFrame, payments: DataFrame) -> DataFrame:
    """One decision per run line: label, failed checks, reason, and one column per check (1 passed, 0 failed)."""
    lines = (resolve_vendor(run, vendors).withColumn("inv", text.strip(F.col("invoice")))
             .withColumn("key", text.inv_key(F.col("inv"))).withColumn("has_invoice", F.col("inv") != "")
             .withColumn("label", distinct_labels(run)))
    lines = checkpointed(lines)            # a payment run is short next to the tables it is compared with, and met five times
    payments = checkpointed(payments.select("dataset_id", "invoice_no", "vendor_id", "supplier"))
    label_first = lines.groupBy("dataset_id", "label").agg(F.min("line_number").alias("label_line"))
    x = (lines.join(approval_for(lines, approvals), LINE, "left")
         .join(already_paid(lines, payments).withColumn("paid", F.lit(True)), LINE, "left")
         .join(earlier_in_run(lines).withColumn("again", F.lit(True)), LINE, "left")
         .join(label_first, ["dataset_id", "label"])
         .join(facts(present(vendors, "has_v")), "dataset_id", "left").join(facts(present(approvals, "has_a")), "dataset_id", "left")
         .join(facts(present(payments, "has_p")), "dataset_id", "left"))
    has_v, has_a = F.col("has_v").isNotNull(), F.col("has_a").isNotNull()
    v, a = F.col("v"), F.col("a")
    status = F.coalesce(text.upper_strip(v["status"]), F.lit(""))
    changed = F.coalesce(text.strip(v["bank_changed_on"]), F.lit(""))
    last4, on_file = text.strip(F.col("bank_last4")), F.coalesce(text.strip(v["bank_acct"]), F.lit(""))
    fails = {
        1: has_v & (v.isNull() | ((status != "") & ~status.startswith("ACTIVE"))),
        2: has_a & (a.isNull() | text.is_blank(a["approved_by"])),
        3: (a.isNotNull() & (a["vendor_key"] != F.col("sup"))) | F.col("name_differs"),
        4: F.col("paid").isNotNull(),
        5: F.col("again").isNotNull(),
        6: (F.col("amount") <= 0) | (F.col("amount") > a["amount"] + F.lit(0.005).cast("decimal(4,3)")),
        7: v.isNotNull() & (changed != "") & ~text.upper_strip(v["bank_verified"]).isin(S.YES) & (changed != text.strip(v["created_on"])),
        8: v.isNotNull() & (last4 != "") & (on_file != "") & (F.right(on_file, F.lit(4)) != F.right(last4, F.lit(4))),
    }
    own_words = {
        1: F.when(F.col("fits").isNotNull(), F.concat(text.strip(F.col("supplier")), F.lit(" matches "), F.col("fits"), F.lit(" vendors ("),
                                                      F.col("fit_ids"), F.lit("); add the vendor id to the run"))),
        3: F.when(F.col("name_differs"), F.concat(F.lit("Vendor "), v["vendor_id"], F.lit(" is "), text.strip(v["name"]), F.lit(", not "),
                                                  text.strip(F.col("supplier")))),
        6: F.when(F.col("amount") <= 0, F.concat(F.lit('Amount "'), text.strip(F.col("amount_text")), F.lit('" is missing, zero or negative'))),
    }
    x = x.select("*", *[F.coalesce(fails[i], F.lit(False)).alias(f"f{i}") for i in CHECKS])
    said = F.concat_ws("; ", *[F.when(F.col(f"f{i}"), F.coalesce(own_words.get(i, F.lit(None)), F.lit(S.GATE_REASONS[i]))) for i in CHECKS])
    failed = F.concat_ws(",", *[F.when(F.col(f"f{i}"), F.lit(str(i))) for i in CHECKS])
    passed = (F.when(((last4 != "") & (on_file != "")) | v.isNull(), "All 8 checks passed")
              .when(last4 == "", "7 of 8 checks passed; the run gives no bank account, so it is paid to the account on file")
              .otherwise("7 of 8 checks passed; the vendor master has no bank account to compare with"))
    not_compared = F.when((failed != "") & v.isNotNull() & (last4 != "") & (on_file == ""),
                          "; bank account not compared: the vendor master has none").otherwise("")
    missing = F.concat_ws(", ", F.when(F.col("has_a").isNull(), "approvals.csv"), F.when(F.col("has_p").isNull(), "payments.csv"),
                          F.when(F.col("has_v").isNull(), "vendors.csv"))
    skipped = F.when(missing != "", F.concat(F.lit(" (not checked: no "), missing, F.lit(")"))).otherwise("")
    return x.select(
        *LINE, F.when(F.col("line_number") == F.col("label_line"), F.col("label"))
        .otherwise(F.concat(F.col("label"), F.lit(" (row "), F.col("line_number") - 1, F.lit(")"))).alias("line"),
        "supplier", F.col("inv").alias("invoice"), "amount",
        F.when(failed != "", "HOLD").otherwise("RELEASE").alias("decision"),
        F.concat(F.when(failed != "", said).otherwise(passed), not_compared, skipped).alias("reason"),
        F.when(failed != "", failed).otherwise("-").alias("failed_checks"),
        *[F.when(F.col(f"f{i}"), 0).otherwise(1).alias(f"c{i}") for i in CHECKS],
        v["vendor_id"].alias("matched_vendor"), a["line_number"].alias("approval_line"))


def final_decision(decisions: DataFrame, cleared: DataFrame) -> DataFrame:
    """Decisions after a person cleared holds; `cleared` is (dataset_id, line, clear_reason)."""
    return (decisions.join(cleared, ["dataset_id", "line"], "left")
            .withColumn("final_decision", F.when(F.col("clear_reason").isNotNull(), "RELEASE (hold cleared)").otherwise(F.col("decision"))))


def release_list(final: DataFrame) -> DataFrame:
    """The lines to pay, as text a spreadsheet will not run."""
    return (final.where("final_decision <> 'HOLD'")
            .select("dataset_id", *[text.safe_cell(F.col(c)).alias(c) for c in ("line", "supplier", "invoice")],
                    F.col("amount").cast("decimal(18,2)").alias("amount")))


def totals(decisions: DataFrame, cleared: DataFrame) -> DataFrame:
    """Lines and money held and released per dataset; a negative line never lowers a total."""
    money = F.greatest(F.col("amount"), F.lit(0).cast("decimal(18,4)"))
    x = final_decision(decisions, cleared).withColumn("held", F.col("final_decision") == "HOLD")
    return x.groupBy("dataset_id").agg(
        F.count("*").alias("lines"), F.sum(money).alias("total"), F.count_distinct("supplier").alias("vendors"),
        F.count_if("held").alias("hold_n"), F.coalesce(F.sum(F.when(F.col("held"), money)), F.lit(0)).alias("hold_amt"),
        F.count_if(~F.col("held")).alias("rel_n"), F.coalesce(F.sum(F.when(~F.col("held"), money)), F.lit(0)).alias("rel_amt"),
        F.count_if((F.col("decision") == "HOLD") & ~F.col("held")).alias("cleared_n"))
