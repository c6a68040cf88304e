"""Checks over recorded payments: paid twice, overpaid, no reference, paid early, weekend release, re-keyed invoices,
and payees the vendor master does not know."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.functions import dates, money, text
from payproof.operators.findings import Found, finding, link
from payproof.scale import checkpointed, line_block, running

FILE = "payments.csv"
GROUP = ["dataset_id", "payee", "invoice_key"]
BUCKET = ["dataset_id", "payee", "cents", "inv_day"]
NO_DAY = 10_000_000           # sorts after every real day


def with_payee(payments: DataFrame) -> DataFrame:
    """Who each payment went to: its vendor id; with none, the one id other lines give the same name; else the name."""
    p = (payments.withColumn("payee_name", text.norm_name(F.col("supplier")))
         .withColumn("own_id", text.upper_strip(F.col("vendor_id"))))
    ids = (p.where("own_id <> ''").groupBy("dataset_id", "payee_name")
           .agg(F.min("own_id").alias("low"), F.max("own_id").alias("high"))
           .where("low = high").select("dataset_id", "payee_name", F.col("low").alias("only_id")))
    joined = p.join(ids, ["dataset_id", "payee_name"], "left")
    return joined.withColumn("payee", F.when(F.col("own_id") != "", F.col("own_id"))
                             .otherwise(F.coalesce("only_id", "payee_name"))).drop("only_id")


def referenced(payments: DataFrame) -> DataFrame:
    """Payments that name an invoice, with the invoice's key."""
    inv = text.strip(F.col("invoice_no"))
    return (with_payee(payments.where(~text.is_blank(F.col("invoice_no"))))
            .withColumn("inv", inv).withColumn("invoice_key", text.inv_key(inv))
            .withColumn("day", F.coalesce(dates.day_number(F.col("pay_date")), F.lit(NO_DAY))))


def settled_references(payments: DataFrame) -> DataFrame:
    """The same, cut to what the checks read and written once: naming the payee costs a join, and the checks that order
    payments read the result several times."""
    return checkpointed(referenced(payments).select(*GROUP, "day", "line_number", "paid_amount", "invoice_amount", "invoice_amount_blank", "inv",
                                                    "invoice_date", text.strip(F.col("supplier")).alias("shown")))


def invoice_totals(ref: DataFrame) -> DataFrame:
    """One row per payee and invoice: net paid, the amount first stated for it, and its first real payment."""
    stated = F.when(F.col("invoice_amount") > 0, F.struct("day", "line_number", "invoice_amount"))
    paid = F.when(F.col("paid_amount") > 0, F.struct("day", "line_number", "paid_amount", "invoice_amount",
                                                     "invoice_amount_blank", "inv"))
    return ref.groupBy(*GROUP).agg(
        F.sum("paid_amount").alias("net"),
        F.min(stated).getField("invoice_amount").alias("first_amount"),
        F.min(paid).alias("first_paid"),
        F.count_if(F.col("paid_amount") > 0).alias("times_paid"))


def order_of_payment(ref: DataFrame) -> DataFrame:
    """Position of every payment within its invoice: by date, undated last, then by line."""
    return running(ref, GROUP, [("_day", F.col("day")), ("_blk", line_block(F.col("line_number")))],
                   [F.col("line_number")], {"earlier": F.lit(1)}, settle=False)


def overpaid(payments: DataFrame, limits: dict) -> Found:
    """5.1, decided on the first real payment of an invoice, which the totals already carry."""
    t = invoice_totals(referenced(payments))
    first = F.col("first_paid")
    owed = F.when(first["invoice_amount_blank"], F.col("first_amount")).otherwise(first["invoice_amount"])
    hit = t.withColumn("owed", owed).where(first["paid_amount"] > F.col("owed") + F.lit(limits["tolerance"]))
    title = F.concat(first["inv"], F.lit(" paid $"), money.fmt(first["paid_amount"]),
                     F.lit(" against an invoice of $"), money.fmt(F.col("owed")))
    return Found(finding(hit, "Payments", "5.1", "Medium", F.bround(first["paid_amount"] - F.col("owed"), 2), title, FILE,
                         first["line_number"]))


def _paid_again(payments: DataFrame, limits: dict) -> tuple[DataFrame, DataFrame]:
    """(payments of invoices whose net is above them, those of them that 5.2 is about)."""
    ref = settled_references(payments)
    tol = F.lit(limits["tolerance"])
    over = (invoice_totals(ref).withColumn("due", F.coalesce("first_amount", F.lit(0)))
            .where((F.col("net") > F.col("due") + tol) & (F.col("times_paid") > 1)).select(*GROUP, "due"))
    rows = ref.select(*GROUP, "day", "line_number", "paid_amount", "inv").join(over, GROUP)
    rows = running(rows, GROUP, [("_day", F.col("day")), ("_blk", line_block(F.col("line_number")))],
                   [F.col("line_number")],
                   {"net_before": F.col("paid_amount"), "paid_before": (F.col("paid_amount") > 0).cast("bigint")})
    paid = rows.where("paid_amount > 0")
    return paid, paid.where((F.col("paid_before") > 0) & (F.col("net_before") + F.col("paid_amount") > F.col("due") + tol))


def paid_twice(payments: DataFrame, limits: dict) -> Found:
    """5.2 counts money: a payment that takes the running net above the invoice, after an earlier payment, on an
    invoice whose net over the whole file is above it too. Totals first, so only such invoices are ordered."""
    paid, hit = _paid_again(payments, limits)
    title = F.concat(F.upper("inv"), F.lit(" was paid more than once"))
    ranked = paid.select(*GROUP, (F.col("paid_before") + 1).alias("nth"), F.col("line_number").alias("related"))
    support = (hit.select(*GROUP, "line_number",
                          F.explode(F.sequence(F.greatest(F.col("paid_before") - (S.limits_with(limits)["earlier_payments"] - 1), F.lit(1)), F.col("paid_before"))).alias("nth"))
               .join(ranked, [*GROUP, "nth"]))
    return Found(finding(hit, "Payments", "5.2", "High", F.col("paid_amount"), title, FILE),
                 link(support, "5.2", FILE, "line_number", "related"))


def no_reference(payments: DataFrame, limits: dict) -> Found:
    hit = payments.where((F.col("paid_amount") > 0) & text.is_blank(F.col("invoice_no")))
    title = F.concat(F.lit("Payment to "), F.col("supplier"), F.lit(" has no invoice reference"))
    return Found(finding(hit, "Payments", "5.3", "Medium", F.col("paid_amount"), title, FILE))


def paid_early(payments: DataFrame, limits: dict) -> Found:
    hit = payments.where((F.col("paid_amount") > 0) & ~text.is_blank(F.col("invoice_no"))
                         & (F.col("pay_date") < F.col("invoice_date")))
    title = F.concat(text.strip(F.col("invoice_no")), F.lit(" paid before the invoice date"))
    return Found(finding(hit, "Payments", "5.3", "Low", F.col("paid_amount"), title, FILE))


def weekend_release(payments: DataFrame, limits: dict) -> Found:
    hit = payments.where((F.col("paid_amount") > 0) & dates.is_weekend(F.col("pay_date")))
    day = F.when(F.weekday("pay_date") == 5, "Saturday").otherwise("Sunday")
    return Found(finding(hit, "Payments", "5.4", "Low", F.col("paid_amount"),
                         F.concat(F.lit("Payment released on a "), day), FILE))


def _equal_payments(payments: DataFrame, limits: dict) -> DataFrame:
    """Payments of buckets (payee, amount, invoice day) with several invoices that are still paid."""
    ref = settled_references(payments)
    rows = (ref.where(F.col("paid_amount") >= F.lit(limits["materiality"]))
            .withColumn("cents", money.cents(F.col("paid_amount")))
            .withColumn("inv_day", F.coalesce(dates.day_number(F.col("invoice_date")), F.lit(NO_DAY)))
            .select(*BUCKET, "invoice_key", "day", "line_number", "inv", "invoice_amount",
                    "shown", text.inv_text(F.col("inv")).alias("keyed")))
    mixed = (rows.groupBy(*BUCKET).agg(F.min("invoice_key").alias("lo"), F.max("invoice_key").alias("hi"))
             .where("lo <> hi").select(*BUCKET))
    live = invoice_totals(ref).where(F.col("net") > F.lit(limits["tolerance"])).select(*GROUP)
    return checkpointed(rows.join(mixed, BUCKET, "left_semi").join(live, GROUP, "left_semi"))


def cut_searches(payments: DataFrame, limits: dict) -> DataFrame:
    """(dataset_id, clause, line_number, rows): where a bound of `limits` left something out. Of 5.2 each payment with more earlier ones than
    are shown with it; of 5.6 each bucket, by its first line, with more payments than one is compared with."""
    bounds = S.limits_with(limits)
    _, again = _paid_again(payments, limits)
    again = again.where(F.col("paid_before") > bounds["earlier_payments"]).select("dataset_id", F.lit("5.2").alias("clause"), "line_number", F.col("paid_before").alias("rows"))
    hot = (_equal_payments(payments, limits).groupBy(*BUCKET).agg(F.count("*").alias("rows"), F.min("line_number").alias("line_number"))
           .where(F.col("rows") > bounds["near_neighbours"] + 1).select("dataset_id", F.lit("5.6").alias("clause"), "line_number", "rows"))
    return again.union(hot)


def near_duplicates(payments: DataFrame, limits: dict) -> Found:
    """5.6: equal payments to one payee whose invoice numbers differ the way a re-keyed number does.

    Equal amounts are compared with their next neighbours in order of payment, as many as `limits` says, or all with all where it says None."""
    tol, neighbours = F.lit(limits["tolerance"]), S.limits_with(limits)["near_neighbours"]
    rows = _equal_payments(payments, limits)
    pairs = _alike(rows) if neighbours is None else _neighbours(rows, neighbours)
    x, y = F.col("x"), F.col("y")
    dated = (x["day"] < NO_DAY) & (y["day"] < NO_DAY)
    near = (F.when((F.col("inv_day") < NO_DAY) | (x["day"] == NO_DAY), True)
            .when(dated, y["day"] - x["day"] <= S.NEAR_WINDOW_DAYS)
            .otherwise(F.col("last_day") - x["day"] <= S.NEAR_WINDOW_DAYS))
    bill = F.greatest(x["invoice_amount"], y["invoice_amount"])
    paid = (F.col("cents") / 100).cast("decimal(18,2)")
    pairs = (pairs.where(x["invoice_key"] != y["invoice_key"]).where(text.similar_invoice(x["keyed"], y["keyed"]))
             .where(near).where(~((bill != 0) & (paid * 2 <= bill + tol))))
    one = (pairs.groupBy("dataset_id", "payee", F.least(x["invoice_key"], y["invoice_key"]).alias("k1"),
                         F.greatest(x["invoice_key"], y["invoice_key"]).alias("k2"))
           .agg(F.min(F.struct("bucket_line", "i", "j", paid.alias("paid"), "x", "y")).alias("p")))
    px, py, amount = F.col("p.x"), F.col("p.y"), F.col("p.paid")
    x_first = px["line_number"] < py["line_number"]
    first, second = F.when(x_first, px["line_number"]).otherwise(py["line_number"]), F.greatest(px["line_number"], py["line_number"])
    title = F.concat(F.when(x_first, px["inv"]).otherwise(py["inv"]), F.lit(" and "),
                     F.when(x_first, py["inv"]).otherwise(px["inv"]), F.lit(" look like one invoice paid twice ($"),
                     money.fmt(amount), F.lit(" each to "),
                     F.when(px["shown"] != "", px["shown"]).otherwise(F.col("payee")), F.lit(")"))
    return Found(finding(one, "Payments", "5.6", "Medium", amount, title, FILE, second, first),
                 link(one, "5.6", FILE, second, first, first))


def _neighbours(rows: DataFrame, neighbours: int) -> DataFrame:
    """Pairs of payments at most so many places apart. Positions come in blocks of so many, so a row meets its own block and the
    next, never its whole group."""
    bucket = BUCKET
    span = rows.groupBy(*bucket).agg(F.min("line_number").alias("bucket_line"),
                                     F.max(F.when(F.col("day") < NO_DAY, F.col("day"))).alias("last_day"))
    rows = running(rows, bucket, [("_day", F.col("day")), ("_blk", line_block(F.col("line_number")))],
                   [F.col("line_number")], {"pos": F.lit(1)}, settle=False)
    rows = rows.withColumn("block", F.floor(F.col("pos") / neighbours))
    fields = ["invoice_key", "day", "line_number", "inv", "invoice_amount", "keyed", "pos", "shown"]
    left = rows.select(*bucket, F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"),
                       F.struct(*fields).alias("x"))
    right = rows.select(*bucket, "block", F.struct(*fields).alias("y"))
    x, y = F.col("x"), F.col("y")
    apart = y["pos"] - x["pos"]
    pairs = left.join(right, [*bucket, "block"]).where(apart.between(1, neighbours)).where(x["invoice_key"] != y["invoice_key"])
    return pairs.join(span, bucket).select("*", x["pos"].alias("i"), y["pos"].alias("j"))


def _alike(rows: DataFrame) -> DataFrame:
    """Pairs of payments whose invoice texts could be one keyed twice, however far apart.

    Rows that differ in nothing that decides on a pair are one, the first paid: the pair shown is of first ones. They meet by equal
    joins on what similar texts share: a text that is part of the other (of the other's parts those as long as a text of the bucket),
    two neighbouring characters swapped, and the text with look-alike letters as digits. Where invoices have no date, payments are
    near by theirs and meet in pieces as long as the window; an undated one counts as of the bucket's last day."""
    last_day = F.max(F.when(F.col("day") < NO_DAY, F.col("day")))
    span = rows.groupBy(*BUCKET).agg(F.min("line_number").alias("bucket_line"), last_day.alias("last_day"))
    day = F.when(F.col("inv_day") == NO_DAY, F.col("day")).otherwise(0)
    fields = ["day", "line_number", "invoice_key", "inv", "invoice_amount", "keyed", "shown"]
    first = (rows.where("keyed <> ''").groupBy(*BUCKET, "invoice_key", "keyed", "invoice_amount", day.alias("at")).agg(F.min(F.struct(*fields)).alias("z"))
             .select(*BUCKET, "keyed", "at", "z").join(span, BUCKET))
    at = F.when(F.col("at") == NO_DAY, F.coalesce("last_day", F.lit(NO_DAY))).otherwise(F.col("at"))
    first = checkpointed(first.withColumn("piece", F.floor(at / (S.NEAR_WINDOW_DAYS + 1))).drop("at"))
    lengths = first.where(F.length("keyed") >= 4).groupBy(*BUCKET).agg(F.collect_set(F.length("keyed")).alias("lengths"))
    t, size = F.col("keyed"), F.length("keyed")
    parts = F.flatten(F.transform(F.filter("lengths", lambda n: n < size), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(t, i, n))))
    swaps = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1, F.lit(1)), F.substr(t, i, F.lit(1)), F.substr(t, i + 2)))
    looks = F.concat(F.lit("~"), F.translate(t, S.LOOKALIKE_LETTERS, S.LOOKALIKE_DIGITS))
    around = F.when(F.col("inv_day") == NO_DAY, F.array(*[F.col("piece") + d for d in (-1, 0, 1)])).otherwise(F.array("piece"))
    long = first.where(size >= 4)
    asking = (long.join(lengths, BUCKET).select(*BUCKET, "bucket_line", "last_day", F.explode(around).alias("piece"), F.col("z").alias("a"), parts.alias("parts"), swaps.alias("swaps"), looks.alias("looks"))
              .withColumn("token", F.explode(F.array_distinct(F.concat("parts", "swaps", F.array("looks"))))).drop("parts", "swaps", "looks"))
    asked = long.select(*BUCKET, "piece", F.col("z").alias("b"), F.explode(F.array(t, looks)).alias("token"))
    a, b = F.col("a"), F.col("b")
    met = asking.hint("merge").join(asked, [*BUCKET, "piece", "token"]).where((a["invoice_key"] != b["invoice_key"]) & (a["keyed"] != b["keyed"]))
    x, y = F.least("a", "b"), F.greatest("a", "b")
    met = met.select(*BUCKET, "bucket_line", "last_day", x.alias("x"), y.alias("y"))
    return met.select("*", *[F.struct(F.col(z)["day"], F.col(z)["line_number"]).alias(n) for z, n in (("x", "i"), ("y", "j"))])


def master_records(vendors: DataFrame) -> DataFrame:
    """One record per vendor id: the last one listed."""
    return (vendors.withColumn("vid", text.upper_strip(F.col("vendor_id"))).groupBy("dataset_id", "vid")
            .agg(F.max(F.struct("line_number", "status", "status_changed_date")).alias("m")))


def master_names(vendors: DataFrame) -> DataFrame:
    """Vendor records per normalised name."""
    return (vendors.select("dataset_id", text.norm_name(F.col("name")).alias("payee_name"),
                           text.upper_strip(F.col("vendor_id")).alias("vid"))
            .groupBy("dataset_id", "payee_name").agg(F.count("*").alias("records"), F.min("vid").alias("vid")))


def word_prefixes(name: str) -> Column:
    """Every shorter form of a name, cut at a word: 'calder logistics uk' gives 'calder' and 'calder logistics'."""
    words = F.split(name, " ")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))),
                       lambda i: F.array_join(F.slice(words, 1, i), " "))


def unknown_names(payments: DataFrame, vendors: DataFrame) -> DataFrame:
    """Payee names, given without an id, that are no master name, no shorter form of one and no longer form of one.
    Prefixes are exploded on both sides, so every step is an equi-join over distinct names."""
    several = F.contains(F.col("payee_name"), F.lit(" "))
    known = master_names(vendors).where("payee_name <> ''").select("dataset_id", "payee_name")
    shorter = known.where(several).select("dataset_id", F.explode(word_prefixes("payee_name")).alias("payee_name"))
    asked = (payments.where(text.is_blank(F.col("vendor_id")) & (F.col("paid_amount") > 0))
             .select("dataset_id", text.norm_name(F.col("supplier")).alias("payee_name")).where("payee_name <> ''").distinct())
    left = asked.join(known.union(shorter).distinct(), ["dataset_id", "payee_name"], "left_anti")
    longer = (left.where(several)
              .select("dataset_id", "payee_name", F.explode(word_prefixes("payee_name")).alias("prefix"))
              .join(known.withColumnRenamed("payee_name", "prefix"), ["dataset_id", "prefix"], "left_semi")
              .select("dataset_id", "payee_name").distinct())
    return left.join(longer, ["dataset_id", "payee_name"], "left_anti")


def unknown_payee(payments: DataFrame, vendors: DataFrame, limits: dict) -> Found:
    """4.1 (Low): money to a name the vendor master knows in no form."""
    hit = (payments.where(text.is_blank(F.col("vendor_id")) & (F.col("paid_amount") > 0))
           .withColumn("payee_name", text.norm_name(F.col("supplier")))
           .join(unknown_names(payments, vendors), ["dataset_id", "payee_name"], "left_semi"))
    title = F.concat(F.col("payment_id"), F.lit(" paid "), text.strip(F.col("supplier")),
                     F.lit(", who has no vendor id and is not in the vendor master"))
    return Found(finding(hit, "Payments", "4.1", "Low", F.col("paid_amount"), title, FILE))


def vendor_status_at_payment(payments: DataFrame, vendors: DataFrame, limits: dict) -> Found:
    """4.1 (Medium): paid a vendor id the master lacks, or one that was not active on the payment date."""
    named = master_names(vendors).where("records = 1").select("dataset_id", "payee_name", F.col("vid").alias("named_id"))
    p = (payments.where("paid_amount > 0").withColumn("payee_name", text.norm_name(F.col("supplier")))
         .join(named, ["dataset_id", "payee_name"], "left")
         .withColumn("own", text.upper_strip(F.col("vendor_id")))
         .withColumn("vid", F.when(F.col("own") != "", F.col("own")).otherwise(F.coalesce("named_id", F.lit(""))))
         .where("vid <> ''").join(master_records(vendors), ["dataset_id", "vid"], "left"))
    status = F.upper(text.strip(F.col("m.status")))
    closed_later = F.coalesce(F.col("pay_date") <= F.col("m.status_changed_date"), F.lit(False))
    missing = F.col("m").isNull()
    inactive = ~missing & (status != "") & ~status.startswith("ACTIVE") & ~closed_later
    title = F.when(missing, F.concat(F.col("payment_id"), F.lit(" paid vendor "), F.col("vid"),
                                     F.lit(", which is not in the vendor master"))) \
        .otherwise(F.concat(F.col("payment_id"), F.lit(" paid "), F.lower("m.status"), F.lit(" vendor "), F.col("vid")))
    return Found(finding(p.where(missing | inactive), "Payments", "4.1", "Medium", F.col("paid_amount"), title, FILE))
