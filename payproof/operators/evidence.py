"""Does a finding quote real lines, and do those lines try to talk to a reviewer?

Findings here have (dataset_id, finding, source_file, line_number, evidence, related_text, related_line).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.functions import screens, text

FILE = ["dataset_id", "source_file"]


def quotes(findings: DataFrame) -> DataFrame:
    """Every quoted text, one row each."""
    return findings.select("dataset_id", "source_file", "finding", F.explode(F.array_compact(F.array(
        F.struct(F.col("evidence").alias("quote"), F.lit(True).alias("main")),
        F.when(F.col("related_text") != "", F.struct(F.col("related_text").alias("quote"), F.lit(False).alias("main")))))).alias("q")
    ).select(*FILE, "finding", "q.quote", "q.main")


def verify(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Add `verified` and `matched_n`. A quote must be the exact line at its number and every related quote a line of
    the file. Texts that occur many times are counted, not listed: equal lines are one text to everything after this.

    Lines and quotes meet by the 256-bit digest of their text, so no text is moved; lines are counted by digest before
    they move, so a text that a third of all lines repeat is one row of the join."""
    q = quotes(findings).withColumn("digest", F.unhex(F.sha2("quote", 256)))
    copies = lines.groupBy(*FILE, F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.count("*").alias("copies"))
    found = (q.select(*FILE, "finding", "digest").join(copies, [*FILE, "digest"], "left").groupBy("dataset_id", "finding")
             .agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("matched_n"), F.bool_and(F.col("copies").isNotNull()).alias("all_found")))
    at = lines.select(*FILE, "line_number", F.col("text").alias("at_line"))
    return (findings.join(at, [*FILE, "line_number"], "left").join(found, ["dataset_id", "finding"])
            .withColumn("verified", F.coalesce(F.col("all_found") & (F.col("at_line") == F.col("evidence")), F.lit(False)))
            .drop("all_found", "at_line"))


def quote_share(checked: DataFrame) -> DataFrame:
    """Percent of findings whose quotes hold, rounded half to even; 100 when there are none."""
    return checked.groupBy("dataset_id").agg(
        F.bround(F.lit(100.0) * F.count_if("verified") / F.count("*"), 0).cast("int").alias("quote_pct"))


def warned(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings whose cited lines, or the lines next to them, address a reviewer."""
    flagged = lines.where(screens.ai_text(F.col("text"))).select(*FILE, "line_number")
    near = flagged.select(*FILE, F.explode(F.array(F.col("line_number") - 1, F.col("line_number"), F.col("line_number") + 1)).alias("cited")).distinct()
    cited = findings.select(*FILE, "finding", F.explode(F.array_compact(F.array("line_number", "related_line"))).alias("cited"))
    return (cited.join(near, [*FILE, "cited"], "left_semi").select("dataset_id", "finding").distinct()
            .withColumn("warning", F.lit(S.WARN_AI_TEXT)))


def guarded(engine: Column, warning: Column, clause: Column, verdict: Column, reason: Column) -> tuple[Column, Column]:
    """(verdict, reason) after the guard: wording in the evidence can neither dismiss a rule finding nor confirm a
    model's."""
    by_rule = engine.isin("rules", "rules+skeptic")
    own = F.when(clause.isin(S.PATTERN_CLAUSES), "Doubtful").otherwise("Confirmed")
    keep, hold = warning & by_rule & (verdict == "Doubtful"), warning & ~by_rule & (verdict == "Confirmed")
    return (F.when(keep, own).when(hold, "Doubtful").otherwise(verdict),
            F.when(keep, F.concat(F.lit("The Skeptic's doubt was not used, because the line contains text addressed to an AI reviewer; "
                                        "the rule's finding stands. The Skeptic said: "), reason))
            .when(hold, F.concat(F.lit("Not confirmed, because the line contains text addressed to an AI reviewer. The Skeptic said: "), reason))
            .otherwise(reason))


def accept_external(proposed: DataFrame, lines: DataFrame, policy: DataFrame) -> DataFrame:
    """Findings proposed from outside, kept only when the clause is one of the area's and the quote is the exact line;
    severity falls back to Medium, and of repeats on a line and clause the most severe stays."""
    sev = F.initcap(text.strip(F.col("severity")))
    rank = F.array_position(F.array(*[F.lit(s) for s in S.SEVERITIES]), F.col("severity"))
    title = text.strip(F.col("title"))
    kept = (proposed.withColumn("line_number", text.line_no(F.col("line_text"))).where("line_number IS NOT NULL")
            .join(policy.select("clause", "area"), ["clause", "area"], "left_semi")
            .join(lines.where(~text.is_blank(F.col("text"))).withColumnRenamed("text", "evidence"), [*FILE, "line_number", "evidence"], "left_semi")
            .withColumn("severity", F.when(sev.isin(S.SEVERITIES), sev).otherwise("Medium"))
            .withColumn("title", F.when(title == "", "Untitled finding").otherwise(title)))
    fields = [c for c in kept.columns if c not in ("dataset_id", "line_number", "clause")]
    return (kept.groupBy("dataset_id", "line_number", "clause")
            .agg(F.min(F.struct(rank.alias("rank"), F.col("finding").alias("first"), F.struct(*fields).alias("row"))).getField("row").alias("chosen"))
            .select("dataset_id", "line_number", "clause", "chosen.*"))
