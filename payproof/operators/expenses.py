"""Checks over expense claims."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.functions import dates, money, screens, text
from payproof.operators.findings import Found, finding, link
from payproof.scale import line_block, running

FILE = "expenses.csv"


def meals(expenses: DataFrame, limits: dict) -> Found:
    lim = limits["meal_limit"]
    people = screens.people_of(F.col("people"), F.col("notes"))
    each = F.col("amount").cast("double") / F.col("heads")
    hit = (expenses.where(text.upper_strip(F.col("category")).isin(S.MEAL_CATEGORIES)).withColumn("heads", people)
           .where(F.when(F.col("heads") > 0, F.col("amount") > F.col("heads") * F.lit(lim)).otherwise(F.col("amount") > F.lit(lim))))
    title = F.when(F.col("heads") > 0, F.concat(F.lit("Meal at $"), money.fmt(each), F.lit(" per person (limit $"), money.fmt(F.lit(lim)), F.lit(")"))) \
        .otherwise(F.concat(F.lit("Meal of $"), money.fmt(F.col("amount")), F.lit(" with no head count recorded (limit $"),
                            money.fmt(F.lit(lim)), F.lit(" per person)")))
    return Found(finding(hit, "Expenses", "6.1", "Low", F.col("amount"), title, FILE))


def no_receipt(expenses: DataFrame, limits: dict) -> Found:
    hit = expenses.where((F.col("amount") > F.lit(limits["receipt_limit"])) & (screens.receipt_of(F.col("receipt_ref")) == "")
                         & ~F.col("category").rlike(screens.NO_RECEIPT_KINDS))
    title = F.concat(F.lit("Claim "), F.col("claim_id"), F.lit(" of $"), money.fmt(F.col("amount")), F.lit(" has no receipt"))
    return Found(finding(hit, "Expenses", "6.2", "Medium", F.col("amount"), title, FILE))


def personal_item(expenses: DataFrame, limits: dict) -> Found:
    hit = expenses.where(F.col("notes").rlike(screens.PERSONAL) & ~F.col("notes").rlike(screens.PROFESSIONAL))
    title = F.concat(F.lit("Personal item claimed: "), F.lower(text.strip(F.col("notes"))))
    return Found(finding(hit, "Expenses", "6.3", "Low", F.col("amount"), title, FILE))


def receipt_again(expenses: DataFrame, limits: dict) -> Found:
    """6.5: every claim after the first with the same receipt."""
    rows = (expenses.withColumn("ref", screens.receipt_of(F.col("receipt_ref"))).where("ref <> ''")
            .withColumn("receipt", F.regexp_replace(F.upper("ref"), r"(?U)\s+", "")))
    first = rows.groupBy("dataset_id", "receipt").agg(F.min("line_number").alias("first"), F.count("*").alias("n")).where("n > 1")
    hit = rows.join(first, ["dataset_id", "receipt"]).where("line_number > first")
    title = F.concat(F.lit("The same receipt "), F.col("ref"), F.lit(" was claimed twice"))
    return Found(finding(hit, "Expenses", "6.5", "High", F.col("amount"), title, FILE),
                 link(hit, "6.5", FILE, "line_number", "first"))


def trip_days(expenses: DataFrame) -> DataFrame:
    """Days on or next to a trip claim, per person, with the lowest and highest line of the claims that say so."""
    trips = (expenses.where(F.col("date").isNotNull()
                            & (F.col("category").rlike(screens.TRIP_CATEGORY) | F.col("notes").rlike(screens.TRAVEL))
                            & (F.lower(text.strip(F.col("notes"))) != "business purpose recorded"))
             .withColumn("person", text.person_key(F.col("employee")))
             .groupBy("dataset_id", "person", "date").agg(F.min("line_number").alias("low"), F.max("line_number").alias("high")))
    return (trips.select("dataset_id", "person", F.explode(F.array(F.date_sub("date", 1), F.col("date"), F.date_add("date", 1))).alias("date"), "low", "high")
            .groupBy("dataset_id", "person", "date").agg(F.min("low").alias("low"), F.max("high").alias("high")))


def weekend_claim(expenses: DataFrame, limits: dict) -> Found:
    """6.4; travel spend within a day of another trip claim of the same person is normal."""
    claims = (expenses.where(dates.is_weekend(F.col("date")) & text.is_blank(F.col("notes")))
              .withColumn("person", text.person_key(F.col("employee")))
              .join(trip_days(expenses), ["dataset_id", "person", "date"], "left"))
    another = F.coalesce((F.col("low") != F.col("line_number")) | (F.col("high") != F.col("line_number")), F.lit(False))
    hit = claims.where(~(F.col("category").rlike(screens.TRAVEL_SPEND) & another))
    title = F.concat(F.lit("Weekend expense "), F.col("claim_id"), F.lit(" with no reason given"))
    return Found(finding(hit, "Expenses", "6.4", "Low", F.col("amount"), title, FILE))


def under_receipt_limit(expenses: DataFrame, limits: dict) -> Found:
    """6.6: three claims in a row by one person within 30 days, each just under the receipt limit and without one.

    The count restarts after a finding, so findings are every third claim of a run in which each claim and the two
    before it lie within 30 days. A run ends where two steps span more than 30 days, which can happen only about once
    a fortnight: a person's runs stay few however many claims there are, and only the runs are folded."""
    lim = limits["receipt_limit"]
    key = ["dataset_id", "person"]
    rows = (expenses.where(F.col("amount").between(lim * 9 / 10, lim) & (screens.receipt_of(F.col("receipt_ref")) == "")
                           & F.col("date").isNotNull()
                           & ~F.concat("category", F.lit(" "), "notes").rlike(screens.NO_RECEIPT_KINDS))
            .withColumn("person", text.person_key(F.col("employee"))).where("person <> ''")
            .select(*key, "line_number", "employee", "amount", dates.day_number(F.col("date")).alias("day")))
    enough = rows.groupBy(*key).agg(F.count("*").alias("claims")).where("claims >= 3")
    rows = running(rows.join(enough, key), key, [("_day", F.col("day")), ("_blk", line_block(F.col("line_number")))],
                   [F.col("line_number")], {"pos": F.lit(1)})
    earlier = rows.select(*key, (F.col("pos") + 2).alias("pos"), F.col("day").alias("day2"))
    gaps = (rows.join(earlier, [*key, "pos"], "left").where("day2 IS NULL OR day - day2 > 30")
            .groupBy(*key, "claims").agg(F.array_sort(F.collect_set("pos")).alias("gaps")))
    # between two gaps lies a run; `shift` is 1 when the finding that ends the run before still holds its first claim
    edges = F.concat("gaps", F.array(F.col("claims")))
    start = F.struct(F.lit(-1).cast("bigint").alias("last"), F.array().cast("array<struct<a:bigint,z:bigint>>").alias("runs"))

    def step(acc: Column, i: Column) -> Column:
        a, z = F.element_at(edges, i) + 1, F.element_at(edges, i + 1) - 1
        begin = F.greatest(a, F.when(acc["last"] >= 0, acc["last"] + 3).otherwise(a))
        last = F.when(begin <= z, begin + F.floor((z - begin) / 3) * 3).otherwise(acc["last"])
        return F.struct(last.cast("bigint").alias("last"),
                        F.when(begin <= z, F.array_append(acc["runs"], F.struct(begin.cast("bigint").alias("a"), z.cast("bigint").alias("z"))))
                        .otherwise(acc["runs"]).alias("runs"))
    runs = gaps.select(*key, F.aggregate(F.sequence(F.lit(1), F.size("gaps")), start, step)["runs"].alias("runs"))
    ends = (rows.select(*key, F.col("pos").alias("end")).join(runs, key)
            .where(F.exists("runs", lambda r: F.col("end").between(r["a"], r["z"]) & ((F.col("end") - r["a"]) % 3 == 0)))
            .select(*key, "end"))
    member = (ends.select(*key, "end", F.explode(F.sequence(F.col("end") - 2, F.col("end"))).alias("pos")).join(rows, [*key, "pos"]))
    hit = member.groupBy(*key, "end").agg(F.sum("amount").alias("total"), F.max(F.struct("line_number", "employee")).alias("last"))
    title = F.concat(text.strip(F.col("last.employee")), F.lit(" made 3 claims without a receipt just under the $"),
                     money.fmt(F.lit(lim)), F.lit(" receipt limit within 30 days"))
    support = (member.join(hit.select(*key, "end", F.col("last.line_number").alias("at")), [*key, "end"]).where("line_number <> at"))
    return Found(finding(hit, "Expenses", "6.6", "Low", F.bround("total", 2), title, FILE, F.col("last.line_number")),
                 link(support, "6.6", FILE, "at", "line_number"))
