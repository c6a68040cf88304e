"""Checks over purchase orders and approved invoices."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof.functions import dates, money, text
from payproof.operators.findings import Found, finding, link
from payproof.scale import checkpointed, line_block, running

FILE = "approvals.csv"
NO_START = 10_000_000          # further back than any day


def label() -> Column:
    return F.when(F.col("doc_no") != "", F.col("doc_no")).otherwise(F.col("record_id"))


def is_po() -> Column:
    return text.upper_strip(F.col("type")) == "PO"


def self_approved(approvals: DataFrame, limits: dict) -> Found:
    hit = approvals.where(text.same_person(text.person_parts(F.col("requested_by")), text.person_parts(F.col("approved_by"))))
    title = F.concat(label(), F.lit(" raised and approved by the same person"))
    return Found(finding(hit, "Approvals", "1.2", "High", F.col("amount"), title, FILE))


def exempt(limits: dict) -> Column:
    return text.po_exempt(F.col("vendor"), limits.get("po_exempt_words"), limits.get("po_exempt_vendors"))


def no_purchase_order(approvals: DataFrame, limits: dict) -> Found:
    hit = approvals.where((F.col("amount") > F.lit(limits["po_limit"])) & ~text.has_po(F.col("po_no"))
                          & text.is_invoice_type(F.col("type")) & ~exempt(limits))
    title = F.concat(label(), F.lit(" for $"), money.fmt(F.col("amount")), F.lit(" has no purchase order"))
    return Found(finding(hit, "Approvals", "1.1", "Medium", F.col("amount"), title, FILE))


# ---- purchase orders and the invoices billed against them
def po_fields() -> Column:
    return F.struct("line_number", "amount", "date", "doc_no")


def orders_by_vendor(approvals: DataFrame) -> DataFrame:
    """The first purchase order of each number and vendor."""
    return (approvals.where(is_po())
            .groupBy("dataset_id", F.lower(text.strip(F.col("doc_no"))).alias("po_key"),
                     text.norm_name(F.col("vendor")).alias("vendor_key"))
            .agg(F.min(po_fields()).alias("po")))


def orders_with_own_number(approvals: DataFrame) -> DataFrame:
    """Purchase orders whose number no other order uses."""
    return (approvals.where(is_po()).groupBy("dataset_id", F.lower(text.strip(F.col("doc_no"))).alias("po_key"))
            .agg(F.count("*").alias("n"), F.min(po_fields()).alias("only_po")).where("n = 1").drop("n"))


def billed_invoices(approvals: DataFrame) -> DataFrame:
    return (approvals.where(text.is_invoice_type(F.col("type")) & text.has_po(F.col("po_no")))
            .withColumn("po_key", F.lower(text.strip(F.col("po_no"))))
            .withColumn("vendor_key", text.norm_name(F.col("vendor"))))


def late_order(approvals: DataFrame, limits: dict) -> Found:
    """1.1: a purchase order dated after the invoice it covers."""
    inv = (billed_invoices(approvals).join(orders_by_vendor(approvals), ["dataset_id", "po_key", "vendor_key"], "left")
           .join(orders_with_own_number(approvals), ["dataset_id", "po_key"], "left")
           .withColumn("po", F.coalesce("po", "only_po")).where(F.col("po.date") > F.col("date")))
    title = F.concat(F.col("po.doc_no"), F.lit(" raised "), F.date_diff(F.col("po.date"), F.col("date")),
                     F.lit(" days after invoice "), F.col("doc_no"))
    return Found(finding(inv, "Approvals", "1.1", "Medium", F.col("amount"), title, FILE, F.col("po.line_number"),
                         F.col("line_number")),
                 link(inv, "1.1", FILE, F.col("po.line_number"), F.col("line_number"), F.col("line_number")))


def _filled(tries: DataFrame) -> DataFrame:
    """Covered invoices of every order, in rounds: take the longest run of invoices that fits, then drop those larger than what is left. Every invoice here is above the director limit, so an order's amount bounds the
    rounds; each round is an aggregate and a piecewise running sum."""
    key = ["dataset_id", "po_line"]
    pending, taken = checkpointed(tries.withColumn("room", F.col("room").cast("decimal(38,4)"))), None
    while True:
        fits = running(pending, key, [("_blk", line_block(F.col("line_number")))], [F.col("line_number")],
                       {"before": F.col("amount")}).where("before + amount <= room").drop("before")
        got = checkpointed(fits.select(*key, "line_number", "amount"))
        taken = got if taken is None else taken.union(got)
        used = got.groupBy(*key).agg(F.sum("amount").alias("used"), F.max("line_number").alias("last"))
        pending = checkpointed(pending.join(used, key).where("line_number > last")
                               .withColumn("room", (F.col("room") - F.col("used")).cast("decimal(38,4)"))
                               .where("amount <= room").select(*key, "line_number", "amount", "room"))
        if pending.isEmpty():
            return taken.select(*key, "line_number")


def covered_by_order(approvals: DataFrame, limits: dict) -> DataFrame:
    """Large invoices billed within their own supplier's purchase order, as (dataset_id, po_line, line_number). In file
    order, each counts while the order's amount still holds it; one that does not fit is passed over."""
    lim, tol = F.lit(limits["director_limit"]), F.lit(limits["tolerance"])
    tries = (billed_invoices(approvals).where((F.col("amount") > lim) & ~text.is_director(F.col("approver_role")))
             .join(orders_by_vendor(approvals), ["dataset_id", "po_key", "vendor_key"]).where(F.col("po.amount") > lim)
             .withColumn("room", F.col("po.amount") + tol).where("amount <= room")
             .select("dataset_id", F.col("po.line_number").alias("po_line"), "line_number", "amount", "room"))
    return _filled(tries)


def not_a_director(approvals: DataFrame, limits: dict) -> Found:
    """1.3; the invoices a flagged order covers support the order's finding."""
    over = approvals.where((F.col("amount") > F.lit(limits["director_limit"])) & ~text.is_director(F.col("approver_role")))
    covered = covered_by_order(approvals, limits)
    hit = over.join(covered.select("dataset_id", "line_number"), ["dataset_id", "line_number"], "left_anti")
    role = F.when(F.col("approver_role") != "", F.col("approver_role")).otherwise("non-director")
    title = F.concat(label(), F.lit(" for $"), money.fmt(F.col("amount")), F.lit(" approved by a "), role, F.lit(", not a director"))
    orders = hit.where(is_po()).select("dataset_id", F.col("line_number").alias("po_line"))
    support = covered.join(orders, ["dataset_id", "po_line"], "left_semi")
    return Found(finding(hit, "Approvals", "1.3", "Medium", F.col("amount"), title, FILE),
                 link(support, "1.3", FILE, "po_line", "line_number"))


def just_under_limit(approvals: DataFrame, limits: dict) -> Found:
    """1.6: one requester, several approvals within 4% under the director limit, to different suppliers."""
    lim = limits["director_limit"]
    rows = (approvals.where(text.is_invoice_type(F.col("type")) & F.col("amount").between(lim * 96 / 100, lim)
                            & ~text.is_director(F.col("approver_role")))
            .withColumn("person", text.person_key(F.col("requested_by"))).where("person <> ''")
            .withColumn("vendor_key", text.norm_name(F.col("vendor"))))
    who = (rows.groupBy("dataset_id", "person")
           .agg(F.count("*").alias("n"), F.min("vendor_key").alias("v1"), F.max("vendor_key").alias("v2"),
                F.sum("amount").alias("total"), F.max(F.struct("line_number", "requested_by")).alias("last"))
           .where("n >= 2 AND v1 <> v2"))
    title = F.concat(text.strip(F.col("last.requested_by")), F.lit(" raised "), F.col("n"), F.lit(" approvals just under the $"),
                     money.fmt(F.lit(lim), 0), F.lit(" director limit"))
    support = (rows.select("dataset_id", "person", "line_number").join(who.select("dataset_id", "person", F.col("last.line_number").alias("at")),
                                                                      ["dataset_id", "person"]).where("line_number <> at"))
    return Found(finding(who, "Approvals", "1.6", "Low", F.bround("total", 2), title, FILE, F.col("last.line_number")),
                 link(support, "1.6", FILE, "at", "line_number"))


# ---- split orders
def _rotation(word: Column) -> Column:
    """The smallest rotation of a word: 'klowe' and 'lowek' share it."""
    return F.array_min(F.transform(F.sequence(F.lit(1), F.length(word)),
                                   lambda i: F.concat(F.substr(word, i), F.left(word, i - 1))))


def _one_person(a, b) -> bool:
    """Whether two short forms match: equal initial and family name, or a user name made of the other's letters."""
    if a.initial and b.initial:
        return (a.initial, a.family) == (b.initial, b.family)
    if bool(a.initial) == bool(b.initial):
        return False
    user, spelt = (a, b) if not a.initial else (b, a)
    return user.word in (spelt.initial + spelt.family, spelt.family + spelt.initial)


def _join_short_forms(group: pd.DataFrame) -> pd.DataFrame:
    """Short forms of one rotation class that fit no full name, in order of appearance: each joins the first earlier
    form it matches. The class is small by construction: a word has no more rotations than letters."""
    seen: list = []
    people: list[str] = []
    for row in group.sort_values("first_line").itertuples():
        match = next((p for other, p in zip(seen, people) if _one_person(row, other)), row.form)
        seen.append(row)
        people.append(match)
    rows = [(r.dataset_id, r.vendor_key, r.word, r.initial, r.family, p) for r, p in zip(seen, people)]
    return pd.DataFrame(rows, columns=["dataset_id", "vendor_key", "word", "initial", "family", "joined"])


def resolve_people(rows: DataFrame) -> DataFrame:
    """One person per spelling within a vendor, as (dataset_id, vendor_key, form, person): a short form joins the only
    full name it fits; when it fits two people it stays itself. Candidates meet on the letters they must share, so
    names are never compared all with all."""
    key = ["dataset_id", "vendor_key"]
    forms = checkpointed(rows.groupBy(*key, "form").agg(F.min(F.struct("line_number", "requested_by")).alias("f"))
             .select(*key, "form", F.col("f.line_number").alias("first_line"), text.person_parts(F.col("f.requested_by")).alias("parts"))
             .withColumn("first", F.coalesce(F.try_element_at("parts", F.lit(1)), F.lit("")))
             .withColumn("family", F.coalesce(F.try_element_at("parts", F.lit(-1)), F.lit("")))
             .withColumn("full", (F.size("parts") >= 2) & (F.length("first") > 1)))
    full = forms.where("full")
    named = full.groupBy(*key, "first", "family").agg(F.min(F.struct("first_line", "form")).getField("form").alias("person"))
    of_full = full.join(named, [*key, "first", "family"]).select(*key, "form", "person")

    short = forms.where("NOT full").withColumn("one_word", F.size("parts") == 1)
    initial = F.left("first", F.lit(1))
    doors = named.select(*key, "person", F.explode(F.array_distinct(F.array(
        F.concat(F.lit("n:"), initial, F.lit("|"), F.col("family")),
        F.concat(F.lit("u:"), initial, F.col("family")), F.concat(F.lit("u:"), F.col("first"), F.col("family")),
        F.concat(F.lit("u:"), F.col("family"), initial)))).alias("door"))
    knocks = short.withColumn("door", F.when(F.col("one_word"), F.concat(F.lit("u:"), F.col("first")))
                              .otherwise(F.concat(F.lit("n:"), initial, F.lit("|"), F.col("family"))))
    fits = (knocks.join(doors, [*key, "door"], "left").groupBy(*key, "form")
            .agg(F.min("person").alias("p1"), F.max("person").alias("p2"), F.first("one_word").alias("one_word"),
                 F.first("first").alias("first"), F.first("family").alias("family"), F.first("first_line").alias("first_line")))
    fits = (fits.withColumn("initial", F.when(F.col("one_word"), F.lit("")).otherwise(F.col("first")))
            .withColumn("word", F.when(F.col("one_word"), F.col("first")).otherwise(F.concat("first", "family")))
            .withColumn("family", F.when(F.col("one_word"), F.lit("")).otherwise(F.col("family"))))
    classes = (fits.where("p1 IS NULL AND word <> ''").groupBy(*key, "word", "initial", "family")
               .agg(F.min(F.struct("first_line", "form")).alias("m"))
               .select(*key, "word", "initial", "family", "m.first_line", "m.form"))
    joined = (classes.withColumn("rotation", _rotation(F.col("word"))).groupBy(*key, "rotation")
              .applyInPandas(_join_short_forms, "dataset_id string, vendor_key string, word string, initial string, family string, joined string"))
    of_short = (fits.join(joined, [*key, "word", "initial", "family"], "left")
                .select(*key, "form", F.when(F.col("p1") == F.col("p2"), F.col("p1")).when(F.col("p1").isNotNull(), F.col("form"))
                        .otherwise(F.coalesce("joined", "form")).alias("person")))
    return of_full.union(of_short)


def split_candidates(approvals: DataFrame, limits: dict) -> DataFrame:
    return (approvals.where(text.is_invoice_type(F.col("type")) & ~text.has_po(F.col("po_no")) & F.col("date").isNotNull()
                            & (F.col("amount") <= F.lit(limits["director_limit"])) & ~exempt(limits))
            .select("dataset_id", "line_number", "vendor", "requested_by", "amount", dates.day_number(F.col("date")).alias("day"),
                    text.norm_name(F.col("vendor")).alias("vendor_key"), text.person_key(F.col("requested_by")).alias("form")))


def split_orders(approvals: DataFrame, limits: dict) -> Found:
    """1.4: invoices of one vendor and requester, none above the director limit, that together pass it within a few
    days.

    A window always ends with a day, so the walk from one finding to the next only depends on the days on which a
    window can start. Day totals find those days; only their rows are ordered; and the walk folds at most one entry
    per day of a vendor and person, however many bills there are."""
    days, lim = limits["split_days"], F.lit(limits["director_limit"])
    key = ["dataset_id", "vendor_key", "person"]
    rows = split_candidates(approvals, limits)
    rows = checkpointed(rows.join(resolve_people(rows), ["dataset_id", "vendor_key", "form"]).drop("form"))
    per_day = rows.groupBy(*key, "day").agg(F.sum("amount").alias("total"), F.count("*").alias("n"),
                                            F.sum(F.greatest(F.col("amount"), F.lit(0))).alias("most"))
    ahead = per_day.select(*key, F.explode(F.sequence(F.col("day") - days, F.col("day"))).alias("start"), "day", "total", "n", "most")
    reach = (ahead.groupBy(*key, F.col("start").alias("day"))
             .agg(F.sum("total").alias("window_total"), F.sum("n").alias("window_n"), F.sum("most").alias("window_most"))
             .where((F.col("window_most") > lim) & (F.col("window_n") >= 2)).drop("window_most"))
    starts = running(rows.join(reach, [*key, "day"]), [*key, "day"], [("_blk", line_block(F.col("line_number")))],
                     [F.col("line_number")], {"spent": F.col("amount"), "passed": F.lit(1)})
    able = checkpointed(starts.withColumn("total", F.col("window_total") - F.col("spent")).withColumn("n", F.col("window_n") - F.col("passed"))
            .where((F.col("n") >= 2) & (F.col("total") > lim))
            .groupBy(*key, "day").agg(F.min(F.struct("line_number", "total", "n")).alias("s")))
    none = F.array().cast("array<int>")

    def walk(acc: Column, d: Column) -> Column:
        free = (F.size(acc) == 0) | (d > F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-NO_START)) + days)
        return F.when(free, F.array_append(acc, d)).otherwise(acc)
    picked = (able.groupBy(*key).agg(F.aggregate(F.array_sort(F.collect_set("day")), none, walk).alias("days"))
              .select(*key, F.explode("days").alias("day")).join(able, [*key, "day"])
              .select(*key, F.col("day").alias("start"), "s"))
    inside = (picked.select(*key, "start", "s", F.explode(F.sequence(F.col("start"), F.col("start") + days)).alias("day"))
              .join(rows.select(*key, "day", "line_number", "vendor"), [*key, "day"])
              .where("day > start OR line_number >= s.line_number"))
    last = inside.groupBy(*key, "start", "s").agg(F.max(F.struct("line_number", "vendor")).alias("last"))
    title = F.concat(F.col("s.n"), F.lit(" "), F.col("last.vendor"), F.lit(f" invoices without a PO within {days} days, total $"),
                     money.fmt(F.col("s.total")), F.lit(" - possible split to avoid director approval"))
    support = (inside.join(last.select(*key, "start", F.col("last.line_number").alias("at")), [*key, "start"])
               .where("line_number <> at"))
    return Found(finding(last, "Approvals", "1.4", "Medium", F.bround(F.col("s.total"), 2), title, FILE, F.col("last.line_number")),
                 link(support, "1.4", FILE, "at", "line_number"))

