"""From findings to a reviewer's queue: numbering, texts, cases, priority, decisions, and what decisions teach."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.functions import money
from payproof.scale import checkpointed, components, line_block, running


def rank_in(c: Column, values: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), c)


def policy_table(spark: SparkSession, limits: dict | None = None) -> DataFrame:
    """The thirty clauses, their amounts shown as currently set. A fixed table, so small that it is always broadcast."""
    L = S.limits_with(limits)
    swap = [("$2,500", f"${L['po_limit']:,.0f}"), ("$10,000", f"${L['director_limit']:,.0f}"),
            ("$75.00", f"${L['meal_limit']:,.2f}"), ("$25.00", f"${L['receipt_limit']:,.2f}"),
            ("within 30 days of being set up", f"within {L['new_vendor_days']} days of being set up")]
    rows = []
    for clause, area, words in S.POLICY:
        for old, new in swap:
            words = words.replace(old, new)
        rows.append((clause, area, words))
    return spark.createDataFrame(rows, "clause string, area string, policy_text string")


def clause_texts(spark: SparkSession) -> DataFrame:
    rows = [(c, *t) for c, t in S.CLAUSE_TEXTS.items()]
    return spark.createDataFrame(rows, "clause string, innocent string, fix string, clears string")


def with_clause_text(findings: DataFrame, policy: DataFrame) -> DataFrame:
    """The policy text of a finding: its clause in its own area, else the clause wherever it stands."""
    own = F.broadcast(policy)
    anywhere = F.broadcast(policy.groupBy("clause").agg(F.min("policy_text").alias("any_text")))
    return (findings.join(own, ["clause", "area"], "left").join(anywhere, "clause", "left")
            .withColumn("policy_text", F.coalesce("policy_text", "any_text", F.lit(""))).drop("any_text"))


def with_texts(findings: DataFrame, texts: DataFrame) -> DataFrame:
    return findings.join(F.broadcast(texts), "clause", "left").fillna("", ["innocent", "fix", "clears"])


def rules_verdict(findings: DataFrame) -> DataFrame:
    """Verdict and reason of a finding made by the rules alone; needs `policy_text`."""
    pattern = F.col("clause").isin(S.PATTERN_CLAUSES)
    lead = F.when(pattern, "Fixed rule check, no AI. A pattern worth a look, not a breach on its own").otherwise("Fixed rule check, no AI")
    return (findings.withColumn("verdict", F.when(pattern, "Doubtful").otherwise("Confirmed"))
            .withColumn("reason", F.concat(lead, F.lit(". Clause "), F.col("clause"), F.lit(": "), F.col("policy_text"))))


def unique(findings: DataFrame) -> DataFrame:
    """One finding per file, line and clause, the most severe; numbered F-01, F-02 ... per dataset by area, severity and
    line. The number is a count of the findings before it, taken piece by piece."""
    ranked = findings.withColumn("area_rank", rank_in(F.col("area"), S.AREAS)).withColumn("sev_rank", rank_in(F.col("severity"), S.SEVERITIES))
    rest = [c for c in ranked.columns if c not in ("dataset_id", "source_file", "line_number", "clause", "area_rank", "sev_rank")]
    order = F.struct("area_rank", "sev_rank", *[c for c in ("title", "anchor") if c in rest])
    one = (ranked.groupBy("dataset_id", "source_file", "line_number", "clause")
           .agg(F.min_by(F.struct("area_rank", "sev_rank", *rest), order).alias("chosen")))
    one = one.select("dataset_id", "source_file", "line_number", "clause", "chosen.*")
    numbered = running(one, ["dataset_id"], [("_area", F.col("area_rank")), ("_sev", F.col("sev_rank")), ("_blk", line_block(F.col("line_number")))],
                       [F.col("line_number"), F.col("source_file"), F.col("clause")], {"before": F.lit(1)})
    number = (F.col("before") + 1).cast("string")
    return (numbered.withColumn("id", F.concat(F.lit("F-"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)))
            .drop("before", "area_rank", "sev_rank"))


def priority(severity: Column, amount: Column, verdict: Column) -> Column:
    weight = F.coalesce(*[F.when(severity == s, w) for s, w in S.SEVERITY_WEIGHT.items()], F.lit(1.0))
    sure = F.when(verdict == "Confirmed", 1.0).when(verdict.isin("Doubtful", "Not checked"), 0.5).otherwise(0.8)
    value = F.coalesce(amount.cast("double"), F.lit(0.0))
    return F.bround(weight * (1 + F.log10(F.greatest(value, F.lit(1.0)))) * sure, 2)


def cases(findings: DataFrame) -> DataFrame:
    """(dataset_id, finding, case): findings that cite a line in common, directly or through others.

    A line is known by its text: every line equal to a quote belongs to it, so two findings share a line just when
    they share a text of a file. That keeps a text with a million copies one text instead of a million."""
    def node(finding: str) -> Column:
        return F.struct("dataset_id", F.col(finding).isNull().alias("absent"), F.col(finding).alias("finding"))
    texts = findings.select("dataset_id", "finding", "source_file", F.explode(F.array_compact(F.array(
        F.col("evidence"), F.when(F.col("related_text") != "", F.col("related_text"))))).alias("t"))
    said = checkpointed(texts.select("dataset_id", "finding", F.unhex(F.sha2(F.concat_ws("\u0001", "dataset_id", "source_file", "t"), 256)).alias("digest")))
    # a text that one finding alone quotes links nothing; the findings of another are linked to the first of them
    shared = (said.groupBy("digest").agg(F.min("finding").alias("first"), F.max("finding").alias("last"), F.bool_or(F.col("finding").isNull()).alias("absent"))
              .where("first < last OR absent AND first IS NOT NULL").select("digest", "first"))
    links = said.join(shared.hint("merge"), "digest").where("NOT finding <=> first")
    labels = components(links.select(node("finding").alias("a"), node("first").alias("b")))
    own = said.select("dataset_id", "finding").distinct().withColumn("node", node("finding"))
    return own.join(labels, "node", "left").select("dataset_id", "finding", F.coalesce("component.finding", "finding").alias("case"))


def case_list(findings: DataFrame, members: DataFrame, limits: dict, demoted: DataFrame | None = None) -> DataFrame:
    """One row per case: its priority, what it is worth (its largest finding, as findings of a case overlap), whether
    it is minor, and which of its findings can be approved in bulk."""
    f = findings.join(members, ["dataset_id", "finding"])
    if demoted is not None:
        f = f.join(demoted.select("clause", F.lit(True).alias("demoted")), "clause", "left")
    else:
        f = f.withColumn("demoted", F.lit(None).cast("boolean"))
    small = (F.col("amount") > 0) & (F.col("amount") < F.lit(limits["materiality"])) & (F.col("severity") != "High")
    return f.groupBy("dataset_id", "case").agg(
        F.count("*").alias("findings"), F.max(priority(F.col("severity"), F.col("amount"), F.col("verdict"))).alias("priority"),
        F.max("amount").alias("worth"), F.bool_and(small | F.coalesce("demoted", F.lit(False))).alias("minor"))


def ranked_cases(case_rows: DataFrame) -> DataFrame:
    """Cases in the order a reviewer sees them. Priorities are cut into pieces by their value, then by case number."""
    step = (-F.round(F.col("priority") * 100)).cast("bigint")          # priorities have two decimals
    r = running(case_rows, ["dataset_id"], [("_p", step), ("_blk", line_block(F.col("case")))], [F.col("case")], {"before": F.lit(1)})
    return r.withColumn("rank", F.col("before") + 1).drop("before")


def bulk_approvable(findings: DataFrame, members: DataFrame, decisions: DataFrame, warnings: DataFrame) -> DataFrame:
    """Undecided findings of cases in which every undecided finding is Confirmed and carries no warning."""
    open_ = (findings.join(members, ["dataset_id", "finding"]).join(decisions, ["dataset_id", "finding"], "left_anti")
             .join(warnings, ["dataset_id", "finding"], "left"))
    good = (open_.groupBy("dataset_id", "case").agg(F.bool_and((F.col("verdict") == "Confirmed") & F.col("warning").isNull()).alias("good"))
            .where("good").drop("good"))
    return open_.join(good, ["dataset_id", "case"], "left_semi").select("dataset_id", "finding")


def in_queue(findings: DataFrame, shadow: list[str]) -> DataFrame:
    return findings.where(~F.col("clause").isin(shadow)) if shadow else findings


def not_suppressed(findings: DataFrame, decisions: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Undecided findings that match a suppression are set aside; decided ones stay."""
    decided = decisions.select("dataset_id", "finding").distinct().withColumn("decided", F.lit(True))
    match = suppressions.select("clause", "source_file", "entity").distinct().withColumn("matched", F.lit(True))
    return (findings.join(decided, ["dataset_id", "finding"], "left").join(match, ["clause", "source_file", "entity"], "left")
            .where("decided IS NOT NULL OR matched IS NULL").drop("decided", "matched"))


def with_decisions(findings: DataFrame, decisions: DataFrame, shadow: list[str], warnings: DataFrame) -> DataFrame:
    status = F.when(F.col("clause").isin(shadow), "Shadow (not in review)").otherwise(F.coalesce("status", F.lit("Pending")))
    d = decisions.select("dataset_id", "finding", "status", F.col("reason").alias("reviewer_reason"), "owner", "note")
    return (findings.join(d, ["dataset_id", "finding"], "left").join(warnings, ["dataset_id", "finding"], "left")
            .withColumn("decision", status).fillna("", ["reviewer_reason", "owner", "note", "warning"]).drop("status"))


def decision_counts(findings: DataFrame, decisions: DataFrame, shadow: list[str]) -> DataFrame:
    """Approved, rejected, pending and shadow findings per dataset, and the approved money counted once per case, with
    cases built from the approved findings alone."""
    d = findings.join(decisions.select("dataset_id", "finding", "status"), ["dataset_id", "finding"], "left")
    hidden = F.col("clause").isin(shadow)
    counts = d.groupBy("dataset_id").agg(
        F.count_if(~hidden & (F.col("status") == "Approved")).alias("approved"), F.count_if(~hidden & (F.col("status") == "Rejected")).alias("rejected"),
        F.count_if(~hidden & F.col("status").isNull()).alias("pending"), F.count_if(hidden).alias("shadow"))
    approved = d.where(~hidden & (F.col("status") == "Approved"))
    value = (approved.join(cases(approved), ["dataset_id", "finding"]).groupBy("dataset_id", "case").agg(F.max("amount").alias("worth"))
             .groupBy("dataset_id").agg(F.sum("worth").alias("value")))
    return counts.join(value, "dataset_id", "left").withColumn("value", F.bround(F.coalesce("value", F.lit(0)), 2))


def rule_health(findings: DataFrame, decisions: DataFrame, kept_normal: list[str]) -> DataFrame:
    """Per clause, how its findings fared. A rule rejected most of the time is demoted unless an admin keeps it."""
    g = (findings.select("dataset_id", "finding", "clause").join(decisions, ["dataset_id", "finding"]).groupBy("clause")
         .agg(F.count_if(F.col("status") == "Approved").alias("approved"), F.count_if(F.col("status") != "Approved").alias("rejected")))
    n = F.col("approved") + F.col("rejected")
    rate = F.col("rejected") / n
    return (g.withColumn("decisions", n).withColumn("reject_rate", rate)
            .withColumn("rule_status", F.when((n >= S.DEMOTE_MIN) & (rate >= S.DEMOTE_RATE) & ~F.col("clause").isin(kept_normal or [""]), "Demoted")
                        .otherwise("Normal")))


def shadow_precision(marks: DataFrame) -> DataFrame:
    """Marks per shadow clause (`real` says a person found it real), and whether it has earned its place."""
    g = marks.groupBy("clause").agg(F.count("*").alias("marks"), F.avg(F.col("real").cast("double")).alias("precision"))
    return g.withColumn("ready", (F.col("marks") >= S.PROMOTE_MIN) & (F.col("precision") >= S.PROMOTE_PRECISION))


def limit_hints(findings: DataFrame, decisions: DataFrame, limits: dict) -> DataFrame:
    """A higher limit for clauses whose rejected findings are all at most a quarter over it."""
    known = F.coalesce(*[F.when(F.col("clause") == c, F.lit(limits[k])) for c, k in S.LIMIT_OF_CLAUSE.items()])
    r = (findings.join(decisions.where("status = 'Rejected'").select("dataset_id", "finding"), ["dataset_id", "finding"], "left_semi")
         .where(~((F.col("clause") == "1.1") & F.contains("title", F.lit(" days after invoice "))))
         .withColumn("current_limit", known).where("current_limit IS NOT NULL"))
    lim = F.col("current_limit")
    return (r.groupBy("clause", "current_limit")
            .agg(F.count("*").alias("n"), F.bool_and((F.col("amount") > lim) & (F.col("amount") <= lim * F.lit(1.25).cast("decimal(3,2)"))).alias("close"),
                 F.max("amount").alias("top"))
            .where("n >= 2 AND close").select("clause", "current_limit", F.bround(F.col("top") + 1, 0).alias("suggested"), "n"))


def vendor_risk(findings: DataFrame, top: int | None = 15) -> DataFrame:
    """Who the findings are about, scored by severity and money; `top` is the report's length, None for everyone."""
    weight = F.coalesce(*[F.when(F.col("severity") == s, int(w)) for s, w in S.SEVERITY_WEIGHT.items()], F.lit(1))
    g = findings.groupBy("dataset_id", F.col("entity").alias("who")).agg(
        F.count("*").alias("findings"), F.count_if(F.col("severity") == "High").alias("high"), F.sum("amount").alias("amount"),
        F.array_join(F.array_sort(F.collect_set("clause")), ", ").alias("clauses"), F.sum(weight).alias("weight"))
    score = F.bround(F.col("weight") * 10 + F.least(F.col("amount").cast("double") / 1000, F.lit(30.0)), 0).cast("bigint")
    g = g.withColumn("risk_score", score).drop("weight")
    if top is None:
        return g
    # Spark keeps only the first rows of a dataset in each task before the shuffle (a window group limit)
    w = Window.partitionBy("dataset_id").orderBy(F.desc("risk_score"), "who")
    return g.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def overview(findings: DataFrame) -> DataFrame:
    """Findings per area and severity, and in total."""
    return findings.rollup("area", "severity").agg(F.count("*").alias("findings")).where("area IS NOT NULL OR severity IS NULL")


def memo(decided: DataFrame, rows: int) -> DataFrame:
    """The largest findings per decision, as the printed memo lists them."""
    w = Window.partitionBy("dataset_id", "decision").orderBy(F.desc("amount"), "finding")
    return decided.withColumn("place", F.row_number().over(w)).where(F.col("place") <= rows)


def run_history(runs: DataFrame) -> DataFrame:
    """Findings of each run by area."""
    return runs.groupBy("dataset_id", "engine", "area").agg(F.count("*").alias("findings"))


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.groupBy("dataset_id", "engine").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "High").alias("high"),
                                                    money.dollars(F.sum("amount")).alias("flagged"))
