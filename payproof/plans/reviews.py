"""Evidence, review, scoring, trail and pattern operators as registered queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.functions import screens
from payproof.operators import evidence, patterns, review, scoring, search, trail
from payproof.plans import bridge
from payproof.plans.registry import o_fmt, o_list, over_views, register, with_views
from payproof.plans.checks import o_screen
from payproof.scale import checkpointed

L = S.LIMITS
SHADOW = ["5.6", "6.3"]
KEPT_NORMAL = ["5.2"]


def reg(name, fn, views, sql=None):
    register(name, over_views(fn, views), with_views(views, sql) if sql else None)


# ---------------------------------------------------------------- evidence
_CHECKED = """
WITH copies AS (SELECT dataset_id, source_file, text, count(*) AS n FROM lines GROUP BY ALL),
checked AS (SELECT f.*, coalesce(m.n, 0) + coalesce(r.n, 0) AS matched_n,
    coalesce(l.text = f.evidence, false) AND (coalesce(f.related_text, '') = '' OR r.n IS NOT NULL) AS verified
  FROM findings f LEFT JOIN lines l ON l.dataset_id = f.dataset_id AND l.source_file = f.source_file AND l.line_number = f.line_number
  LEFT JOIN copies m ON m.dataset_id = f.dataset_id AND m.source_file = f.source_file AND m.text = f.evidence
  LEFT JOIN copies r ON r.dataset_id = f.dataset_id AND r.source_file = f.source_file AND r.text = f.related_text)"""
reg("ev_quote", lambda f, n: evidence.verify(f, n).select("dataset_id", "finding", "verified", "matched_n"), ["findings", "lines"],
    _CHECKED + " SELECT dataset_id, finding, verified, CAST(matched_n AS BIGINT) AS matched_n FROM checked")
reg("quote_pct", lambda f, n: evidence.quote_share(evidence.verify(f, n)), ["findings", "lines"],
    _CHECKED + " SELECT dataset_id, CAST(round_even(100.0 * count(*) FILTER (verified) / count(*), 0) AS INTEGER) AS quote_pct FROM checked GROUP BY dataset_id")
AI_SQL = "regexp_matches({0}, '(?i)" + "|".join(screens.AI_PHRASES).replace("'", "''") + "')"
_WARNED = f"""
WITH flagged AS (SELECT dataset_id, source_file, line_number FROM lines WHERE {AI_SQL.format('text')}),
cited AS (SELECT dataset_id, finding, source_file, unnest([line_number, related_line]) AS n FROM findings),
warned AS (SELECT DISTINCT c.dataset_id, c.finding FROM cited c JOIN flagged f ON f.dataset_id = c.dataset_id AND f.source_file = c.source_file AND abs(f.line_number - c.n) <= 1)"""
reg("ev_neighbours", lambda f, n: evidence.warned(f, n), ["findings", "lines"],
    _WARNED + f" SELECT dataset_id, finding, '{S.WARN_AI_TEXT}' AS warning FROM warned")


def _guarded(runs: DataFrame, lines: DataFrame) -> DataFrame:
    runs = checkpointed(runs.select("dataset_id", "engine", "finding", "clause", "verdict", "reason", "source_file", "line_number", "related_line"))
    w = evidence.warned(runs, lines)
    x = runs.join(w, ["dataset_id", "finding"], "left")
    v, r = evidence.guarded(F.col("engine"), F.col("warning").isNotNull(), F.col("clause"), F.col("verdict"), F.col("reason"))
    return x.select("dataset_id", "engine", "finding", v.alias("verdict"), r.alias("reason"))


reg("fnd_guard", _guarded, ["runs", "lines", ], _WARNED.replace("FROM findings", "FROM runs") + f"""
    SELECT r.dataset_id, engine, r.finding, CASE WHEN w.finding IS NOT NULL AND engine = 'rules' AND verdict = 'Doubtful' THEN CASE WHEN clause IN ({o_list(S.PATTERN_CLAUSES)}) THEN 'Doubtful' ELSE 'Confirmed' END
      WHEN w.finding IS NOT NULL AND engine <> 'rules' AND verdict = 'Confirmed' THEN 'Doubtful' ELSE verdict END AS verdict,
      CASE WHEN w.finding IS NOT NULL AND engine = 'rules' AND verdict = 'Doubtful' THEN 'The Skeptic''s doubt was not used, because the line contains text addressed to an AI reviewer; the rule''s finding stands. The Skeptic said: ' || reason
      WHEN w.finding IS NOT NULL AND engine <> 'rules' AND verdict = 'Confirmed' THEN 'Not confirmed, because the line contains text addressed to an AI reviewer. The Skeptic said: ' || reason ELSE reason END AS reason
    FROM runs r LEFT JOIN warned w ON w.dataset_id = r.dataset_id AND w.finding = r.finding""")

_POLICY_ROWS = ", ".join("('" + "', '".join(x.replace("'", "''") for x in row) + "')" for row in S.POLICY)
_POLICY = f"policy(clause, area, policy_text) AS (VALUES {_POLICY_ROWS})"


def _external(findings: DataFrame, lines: DataFrame) -> DataFrame:
    p = findings.select("dataset_id", "finding", "area", F.when(F.col("finding") % 31 == 0, "Z99").otherwise(F.col("clause")).alias("clause"),
                        F.when(F.col("finding") % 7 == 0, F.lower("severity")).when(F.col("finding") % 17 == 0, "severe").otherwise(F.col("severity")).alias("severity"),
                        "title", "source_file", "evidence", F.concat(F.col("line_number").cast("string"), F.when(F.col("finding") % 19 == 0, ".0").when(
                            F.col("finding") % 23 == 0, ".5").otherwise("")).alias("line_text"))
    kept = evidence.accept_external(p, lines, review.policy_table(findings.sparkSession))
    return kept.select("dataset_id", "finding", "area", "clause", "severity", "title", "source_file", "line_number")


reg("fnd_external", _external, ["findings", "lines"], f"""
    WITH {_POLICY}, p AS (SELECT *, CASE WHEN finding % 31 = 0 THEN 'Z99' ELSE clause END AS c2, CASE WHEN finding % 17 = 0 AND finding % 7 <> 0 THEN 'Medium' ELSE severity END AS s2 FROM findings
      WHERE finding % 23 <> 0 OR finding % 19 = 0),
    kept AS (SELECT p.dataset_id, finding, area, c2 AS clause, s2 AS severity, title, p.source_file, p.line_number FROM p JOIN lines l ON l.dataset_id = p.dataset_id AND l.source_file = p.source_file
      AND l.line_number = p.line_number AND l.text = p.evidence WHERE EXISTS (SELECT 1 FROM policy y WHERE y.clause = p.c2 AND y.area = p.area))
    SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY dataset_id, line_number, clause ORDER BY CASE severity WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, finding) = 1""")

# ---------------------------------------------------------------- findings
_SEV = "CASE severity WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END"
_AREA = "CASE area " + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(S.AREAS)) + " END"


def _doubled(findings: DataFrame) -> DataFrame:
    """Findings plus a milder copy of some, as two checks would raise them."""
    milder = findings.where("line_number % 4 = 0").withColumn("severity", F.lit("Low")).withColumn("title", F.concat("title", F.lit(" again")))
    return findings.union(milder).withColumn("anchor", F.col("finding"))


reg("agg_unique", lambda f: review.unique(_doubled(f)).select("dataset_id", "id", "source_file", "line_number", "clause", "severity", "title"), ["findings"], f"""
    WITH both_ AS (SELECT dataset_id, area, clause, severity, title, source_file, line_number, finding AS anchor FROM findings
      UNION ALL SELECT dataset_id, area, clause, 'Low', title || ' again', source_file, line_number, finding FROM findings WHERE line_number % 4 = 0),
    one AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY dataset_id, source_file, line_number, clause ORDER BY {_AREA}, {_SEV}, title, anchor) = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY {_AREA}, {_SEV}, line_number, source_file, clause) AS k FROM one)
    SELECT dataset_id, 'F-' || CASE WHEN k < 10 THEN '0' ELSE '' END || CAST(k AS VARCHAR) AS id, source_file, line_number, clause, severity, title FROM n""")
reg("ord_findings", lambda f: review.unique(f.withColumn("anchor", F.col("finding"))).select("dataset_id", "id", "finding"), ["findings"], f"""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY {_AREA}, {_SEV}, line_number, source_file, clause) AS k FROM findings)
    SELECT dataset_id, 'F-' || CASE WHEN k < 10 THEN '0' ELSE '' END || CAST(k AS VARCHAR) AS id, finding FROM n""")


def _policy(findings: DataFrame) -> DataFrame:
    return review.policy_table(findings.sparkSession)


_TEXT = f"WITH {_POLICY}, t AS (SELECT f.*, coalesce(own.policy_text, anyw.policy_text, '') AS policy_text FROM findings f LEFT JOIN policy own ON own.clause = f.clause AND own.area = f.area LEFT JOIN (SELECT clause, min(policy_text) AS policy_text FROM policy GROUP BY clause) anyw ON anyw.clause = f.clause)"
reg("fn_clause_text", lambda f: review.with_clause_text(f, _policy(f)).select("dataset_id", "finding", "policy_text"), ["findings"],
    _TEXT + " SELECT dataset_id, finding, policy_text FROM t")
reg("fnd_verdict", lambda f: review.rules_verdict(review.with_clause_text(f, _policy(f))).select("dataset_id", "finding", "verdict", "reason"), ["findings"],
    _TEXT + f""" SELECT dataset_id, finding, CASE WHEN clause IN ({o_list(S.PATTERN_CLAUSES)}) THEN 'Doubtful' ELSE 'Confirmed' END AS verdict,
      'Fixed rule check, no AI' || CASE WHEN clause IN ({o_list(S.PATTERN_CLAUSES)}) THEN '. A pattern worth a look, not a breach on its own' ELSE '' END || '. Clause ' || clause || ': ' || policy_text AS reason FROM t""")
_TEXT_ROWS = ", ".join("('" + c + "', '" + "', '".join(x.replace("'", "''") for x in t) + "')" for c, t in S.CLAUSE_TEXTS.items())
reg("fnd_texts", lambda f: review.with_texts(f, review.clause_texts(f.sparkSession)).select("dataset_id", "finding", "innocent", "fix", "clears"), ["findings"],
    f"WITH t(clause, innocent, fix, clears) AS (VALUES {_TEXT_ROWS}) SELECT dataset_id, finding, innocent, fix, clears FROM findings JOIN t USING (clause)")
reg("fn_policy_render", lambda f: review.with_clause_text(f, review.policy_table(f.sparkSession, {"director_limit": 5000, "new_vendor_days": 45}))
    .groupBy("clause", "policy_text").agg(F.count("*").alias("findings")), ["findings"],
    _TEXT + " SELECT clause, replace(replace(policy_text, '$10,000', '$5,000'), '30 days', '45 days') AS policy_text, count(*) AS findings FROM t GROUP BY ALL")
_PRIO = ("round_even(CASE severity WHEN 'High' THEN 3.0 WHEN 'Medium' THEN 2.0 ELSE 1.0 END::DOUBLE * (1 + log10(greatest(CAST(amount AS DOUBLE), 1.0))) * "
         "CASE verdict WHEN 'Confirmed' THEN 1.0 ELSE 0.5 END::DOUBLE, 2)")
reg("fn_priority", lambda f: f.select("dataset_id", "finding", review.priority(F.col("severity"), F.col("amount"), F.col("verdict")).alias("priority")), ["findings"],
    f"SELECT dataset_id, finding, {_PRIO} AS priority FROM findings")
def o_cases(source: str) -> str:
    """Cases by transitive closure, which is small because cases are."""
    return f"""texts AS (SELECT dataset_id, source_file, finding, unnest([evidence, related_text]) AS t FROM {source}),
    pairs AS (SELECT DISTINCT a.dataset_id, a.finding AS f1, b.finding AS f2 FROM texts a JOIN texts b ON a.dataset_id = b.dataset_id AND a.source_file = b.source_file AND a.t = b.t WHERE a.t <> ''),
    reach(dataset_id, f1, f2) AS (SELECT dataset_id, f1, f2 FROM pairs UNION SELECT r.dataset_id, r.f1, p.f2 FROM reach r JOIN pairs p ON p.dataset_id = r.dataset_id AND p.f1 = r.f2),
    members AS (SELECT dataset_id, f1 AS finding, min(f2) AS "case" FROM reach GROUP BY dataset_id, f1),
    cf AS (SELECT f.*, m."case" FROM {source} f JOIN members m ON m.dataset_id = f.dataset_id AND m.finding = f.finding)"""


CASE_COLUMNS = ["dataset_id", "finding", "source_file", "line_number", "related_line", "clause", "severity", "amount", "verdict", "evidence", "related_text"]


def reg_cases(name: str, fn, views: list[str], sql: str) -> None:
    """A query over cases. Findings are read by several of its steps, so the view is worked out once."""
    register(name, over_views(lambda f, *more: fn(checkpointed(f.select(*CASE_COLUMNS)), *more), views), with_views(views, sql))


reg("cases", lambda f: review.cases(f).groupBy("dataset_id", "case").agg(F.count("*").alias("findings")), ["findings"],
    f"WITH {o_cases('findings')} SELECT dataset_id, \"case\", count(*) AS findings FROM cf GROUP BY ALL")
reg_cases("case_amount", lambda f: review.case_list(f, review.cases(f), L).select("dataset_id", "case", F.col("worth").cast("double").alias("worth")), ["findings"],
          f"WITH {o_cases('findings')} SELECT dataset_id, \"case\", CAST(max(amount) AS DOUBLE) AS worth FROM cf GROUP BY dataset_id, \"case\"")
reg_cases("rev_minor", lambda f: review.case_list(f, review.cases(f), L).select("dataset_id", "case", "minor"), ["findings"],
          f"WITH {o_cases('findings')} SELECT dataset_id, \"case\", bool_and(amount > 0 AND amount < 50 AND severity <> 'High') AS minor FROM cf GROUP BY dataset_id, \"case\"")
reg_cases("ord_cases", lambda f: review.ranked_cases(review.case_list(f, review.cases(f), L)).where("rank <= 20").select("dataset_id", "case", "priority", "rank"), ["findings"],
          f"WITH {o_cases('findings')}, p AS (SELECT dataset_id, \"case\", max({_PRIO}) AS priority FROM cf GROUP BY dataset_id, \"case\") "
          "SELECT dataset_id, \"case\", priority, row_number() OVER (PARTITION BY dataset_id ORDER BY priority DESC, \"case\") AS rank FROM p QUALIFY rank <= 20")
reg_cases("rev_bulk", lambda f, d, n: review.bulk_approvable(f, review.cases(f), d, evidence.warned(f, n)), ["findings", "decisions", "lines"],
          f"{_WARNED.strip()}, {o_cases('findings')}, " + """op AS (SELECT c.*, w.finding IS NOT NULL AS warned FROM cf c LEFT JOIN warned w ON w.dataset_id = c.dataset_id AND w.finding = c.finding
             WHERE NOT EXISTS (SELECT 1 FROM decisions d WHERE d.dataset_id = c.dataset_id AND d.finding = c.finding))
             SELECT dataset_id, finding FROM op QUALIFY bool_and(verdict = 'Confirmed' AND NOT warned) OVER (PARTITION BY dataset_id, "case")""")
reg("rev_shadow", lambda f: review.in_queue(f, SHADOW).select("dataset_id", "finding"), ["findings"],
    f"SELECT dataset_id, finding FROM findings WHERE clause NOT IN ({o_list(SHADOW)})")
reg_cases("rev_counts", lambda f, d: review.decision_counts(f, d, SHADOW).withColumn("value", F.col("value").cast("double")), ["findings", "decisions"],
          f"""WITH j AS (SELECT f.*, d.status, f.clause IN ({o_list(SHADOW)}) AS hidden FROM findings f LEFT JOIN decisions d ON d.dataset_id = f.dataset_id AND d.finding = f.finding),
          ok AS (SELECT * FROM j WHERE NOT hidden AND status = 'Approved'), {o_cases('ok')},
          v AS (SELECT dataset_id, sum(worth) AS value FROM (SELECT dataset_id, "case", max(amount) AS worth FROM cf GROUP BY dataset_id, "case") GROUP BY dataset_id)
          SELECT j.dataset_id, count(*) FILTER (NOT hidden AND status = 'Approved') AS approved, count(*) FILTER (NOT hidden AND status = 'Rejected') AS rejected,
            count(*) FILTER (NOT hidden AND status IS NULL) AS pending, count(*) FILTER (hidden) AS shadow, CAST(coalesce(any_value(v.value), 0) AS DOUBLE) AS value
          FROM j LEFT JOIN v ON v.dataset_id = j.dataset_id GROUP BY j.dataset_id""")
reg("rev_decisions", lambda f, d, n: review.with_decisions(f, d, SHADOW, evidence.warned(f, n)).select("dataset_id", "finding", "decision", "reviewer_reason", "owner", "note", "warning"),
    ["findings", "decisions", "lines"], _WARNED + f"""
    SELECT f.dataset_id, f.finding, CASE WHEN f.clause IN ({o_list(SHADOW)}) THEN 'Shadow (not in review)' ELSE coalesce(d.status, 'Pending') END AS decision, coalesce(d.reason, '') AS reviewer_reason,
      coalesce(d.owner, '') AS owner, coalesce(d.note, '') AS note, CASE WHEN w.finding IS NULL THEN '' ELSE '{S.WARN_AI_TEXT}' END AS warning
    FROM findings f LEFT JOIN decisions d ON d.dataset_id = f.dataset_id AND d.finding = f.finding LEFT JOIN warned w ON w.dataset_id = f.dataset_id AND w.finding = f.finding""")


def _suppressions(findings: DataFrame) -> DataFrame:
    return findings.where("finding % 50 = 1").select("clause", "source_file", "entity")


reg("sup_anti", lambda f, d: review.not_suppressed(f, d, _suppressions(f)).select("dataset_id", "finding"), ["findings", "decisions"], """
    WITH s AS (SELECT DISTINCT clause, source_file, entity FROM findings WHERE finding % 50 = 1)
    SELECT dataset_id, finding FROM findings f WHERE EXISTS (SELECT 1 FROM decisions d WHERE d.dataset_id = f.dataset_id AND d.finding = f.finding)
      OR NOT EXISTS (SELECT 1 FROM s WHERE s.clause = f.clause AND s.source_file = f.source_file AND s.entity = f.entity)""")
_HEALTH = "WITH g AS (SELECT f.clause, count(*) FILTER (status = 'Approved') AS approved, count(*) FILTER (status <> 'Approved') AS rejected FROM findings f JOIN decisions d ON d.dataset_id = f.dataset_id AND d.finding = f.finding GROUP BY f.clause)"
reg("rule_health", lambda f, d: review.rule_health(f, d, KEPT_NORMAL), ["findings", "decisions"], _HEALTH + f"""
    SELECT clause, approved, rejected, approved + rejected AS decisions, rejected / (approved + rejected) AS reject_rate,
      CASE WHEN approved + rejected >= 5 AND rejected / (approved + rejected) >= 0.6 AND clause NOT IN ({o_list(KEPT_NORMAL)}) THEN 'Demoted' ELSE 'Normal' END AS rule_status FROM g""")


def _marks(findings: DataFrame) -> DataFrame:
    return findings.where("finding % 9 = 2").select("clause", (F.col("finding") % 6 != 0).alias("real"))


reg("shadow_prec", lambda f: review.shadow_precision(_marks(f)), ["findings"], """
    SELECT clause, count(*) AS marks, avg(CASE WHEN finding % 6 <> 0 THEN 1.0::DOUBLE ELSE 0 END) AS precision,
      count(*) >= 5 AND avg(CASE WHEN finding % 6 <> 0 THEN 1.0::DOUBLE ELSE 0 END) >= 0.8 AS ready FROM findings WHERE finding % 9 = 2 GROUP BY clause""")


def _near_limit(findings: DataFrame) -> DataFrame:
    """Findings of limit clauses with amounts a little over the limit (or, for 6.2, well over)."""
    return findings.withColumn("clause", F.when(F.col("clause") == "5.6", F.when(F.col("line_number") % 2 == 0, "1.1").otherwise("1.3")).otherwise(F.col("clause"))) \
        .withColumn("amount", F.when(F.col("clause") == "1.3", F.lit(10001) + F.col("finding") % 2400).when(F.col("clause") == "1.1", F.lit(2501) + F.col("finding") % 600)
                    .otherwise(F.col("amount")).cast("decimal(18,4)"))


reg("limit_hints", lambda f, d: review.limit_hints(_near_limit(f), d, L).select("clause", F.col("current_limit").cast("double").alias("current_limit"),
                                                                              F.col("suggested").cast("double").alias("suggested"), "n"), ["findings", "decisions"], """
    WITH x AS (SELECT CASE WHEN clause = '5.6' THEN CASE WHEN line_number % 2 = 0 THEN '1.1' ELSE '1.3' END ELSE clause END AS clause, dataset_id, finding,
        CASE WHEN clause = '5.6' AND line_number % 2 = 1 THEN 10001 + finding % 2400 WHEN clause = '5.6' THEN 2501 + finding % 600 ELSE amount END AS amount FROM findings),
    r AS (SELECT x.*, CASE clause WHEN '1.1' THEN 2500 WHEN '1.3' THEN 10000 WHEN '6.2' THEN 25 END AS lim FROM x JOIN decisions d ON d.dataset_id = x.dataset_id AND d.finding = x.finding WHERE d.status = 'Rejected')
    SELECT clause, CAST(lim AS DOUBLE) AS current_limit, CAST(round_even(max(amount) + 1, 0) AS DOUBLE) AS suggested, count(*) AS n FROM r WHERE lim IS NOT NULL GROUP BY clause, lim
    HAVING count(*) >= 2 AND bool_and(amount > lim AND amount <= lim * 1.25)""")
reg("vendor_risk", lambda f: review.vendor_risk(f).select("dataset_id", "who", "findings", "high", F.col("amount").cast("double").alias("amount"), "clauses", "risk_score", "place"), ["findings"], """
    WITH g AS (SELECT dataset_id, entity AS who, count(*) AS findings, count(*) FILTER (severity = 'High') AS high, CAST(sum(amount) AS DOUBLE) AS amount,
      string_agg(DISTINCT clause, ', ' ORDER BY clause) AS clauses, CAST(round_even(sum(CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) * 10 + least(CAST(sum(amount) AS DOUBLE) / 1000, 30), 0) AS BIGINT) AS risk_score
      FROM findings GROUP BY dataset_id, entity)
    SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY risk_score DESC, who) AS place FROM g QUALIFY place <= 15""")
reg("overview", review.overview, ["findings"], "SELECT area, severity, count(*) AS findings FROM findings GROUP BY ROLLUP (area, severity)")
reg("trends", review.run_history, ["runs"], "SELECT dataset_id, engine, area, count(*) AS findings FROM runs GROUP BY ALL")
reg("trends_totals", review.run_totals, ["runs"], f"SELECT dataset_id, engine, count(*) AS findings, count(*) FILTER (severity = 'High') AS high, CASE WHEN sum(amount) < 0 THEN '-$' || {o_fmt('-sum(amount)')} ELSE '$' || {o_fmt('sum(amount)')} END AS flagged FROM runs GROUP BY ALL")
reg("topk_memo", lambda f, d, n: review.memo(review.with_decisions(f, d, SHADOW, evidence.warned(f, n)), 200).select("dataset_id", "decision", "finding", "place"), ["findings", "decisions", "lines"], f"""
    WITH x AS (SELECT f.*, CASE WHEN f.clause IN ({o_list(SHADOW)}) THEN 'Shadow (not in review)' ELSE coalesce(d.status, 'Pending') END AS decision FROM findings f LEFT JOIN decisions d ON d.dataset_id = f.dataset_id AND d.finding = f.finding)
    SELECT dataset_id, decision, finding, row_number() OVER (PARTITION BY dataset_id, decision ORDER BY amount DESC, finding) AS place FROM x QUALIFY place <= 200""")
reg("new_anti", lambda f: f.join(f.where("finding % 3 <> 0").select("clause", "source_file", "title").distinct(), ["clause", "source_file", "title"], "left_anti")
    .select("dataset_id", "finding"), ["findings"], """SELECT dataset_id, finding FROM findings f WHERE NOT EXISTS (SELECT 1 FROM findings o WHERE o.finding % 3 <> 0 AND o.clause = f.clause
      AND o.source_file = f.source_file AND o.title = f.title)""")

# ---------------------------------------------------------------- scoring
_MATCH = """
WITH kl AS (SELECT DISTINCT dataset_id, id, expect, source_file, position, unnest([line_number, related_line]) AS line FROM answer_key),
pl AS (SELECT *, unnest([line_number, related_line]) AS line FROM runs),
m AS (SELECT p.dataset_id, p.engine, p.finding, k.id, k.position, k.expect, bool_or(p.line = p.line_number) AS own, any_value(p.verdict) AS verdict FROM pl p JOIN kl k ON k.dataset_id = p.dataset_id AND k.source_file = p.source_file
      AND k.line = p.line GROUP BY ALL)"""
# the same one after the other: each finding in turn takes the first of its key rows that nobody took before
_CREDIT = _MATCH + """,
w AS MATERIALIZED (SELECT dataset_id, engine, finding, list(position ORDER BY NOT own, position) AS wishes, row_number() OVER (PARTITION BY dataset_id, engine ORDER BY finding) AS k
      FROM m WHERE expect <> 'trap' GROUP BY dataset_id, engine, finding),
turns(dataset_id, engine, k, used, finding, got) AS (
  SELECT dataset_id, engine, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT dataset_id, engine FROM w)
  UNION ALL SELECT dataset_id, engine, k, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END, finding, got FROM (
    SELECT w.dataset_id, w.engine, w.k, t.used, w.finding, list_filter(w.wishes, lambda x: NOT list_contains(t.used, x))[1] AS got
    FROM turns t JOIN w ON w.dataset_id = t.dataset_id AND w.engine = t.engine AND w.k = t.k + 1)),
credited AS (SELECT t.dataset_id, t.engine, t.finding, a.id FROM turns t JOIN answer_key a ON a.dataset_id = t.dataset_id AND a.position = t.got)"""
reg("sc_match", lambda r, k: scoring.matches(r, k).drop("verdict", "position"), ["runs", "answer_key"], _MATCH + " SELECT dataset_id, engine, finding, id, expect, own FROM m")
reg("score_credit", lambda r, k: scoring.credit(scoring.matches(r, k).where("expect <> 'trap'")), ["runs", "answer_key"], _CREDIT + " SELECT * FROM credited")
reg("score_prf", lambda r, k: scoring.scores(r, k).select("dataset_id", "engine", "planted", "proposed", "true_pos", "false_alarms", "precision", "traps", "traps_flagged", "found", "recall"), ["runs", "answer_key"], _CREDIT + """
    SELECT p.dataset_id, p.engine, k.planted, p.proposed, coalesce(t.true_pos, 0) AS true_pos, p.proposed - coalesce(t.true_pos, 0) AS false_alarms, coalesce(t.true_pos, 0) / p.proposed AS precision,
      k.traps, coalesce(t.traps_flagged, 0) AS traps_flagged, coalesce(c.found, 0) AS found, CASE WHEN k.planted > 0 THEN coalesce(c.found, 0) / k.planted ELSE 0.0 END AS recall
    FROM (SELECT dataset_id, engine, count(*) AS proposed FROM runs GROUP BY ALL) p
    JOIN (SELECT dataset_id, count(*) FILTER (expect <> 'trap') AS planted, count(*) FILTER (expect = 'trap') AS traps FROM answer_key GROUP BY ALL) k USING (dataset_id)
    LEFT JOIN (SELECT dataset_id, engine, count(DISTINCT finding) FILTER (expect <> 'trap') AS true_pos, count(DISTINCT id) FILTER (expect = 'trap') AS traps_flagged FROM m GROUP BY ALL) t
      ON t.dataset_id = p.dataset_id AND t.engine = p.engine
    LEFT JOIN (SELECT dataset_id, engine, count(DISTINCT id) AS found FROM credited GROUP BY ALL) c ON c.dataset_id = p.dataset_id AND c.engine = p.engine""")
reg("score_traps", lambda r, k: scoring.trap_kinds(scoring.matches(r, k), k), ["runs", "answer_key"], _MATCH + """
    SELECT DISTINCT m.dataset_id, engine, replace(split_part(description, ')', 1), 'TRAP (', '') AS kind FROM m JOIN answer_key k ON k.dataset_id = m.dataset_id AND k.id = m.id WHERE m.expect = 'trap'""")
reg("score_skeptic", scoring.skeptic_scores, ["runs", "answer_key"], _MATCH + """,
    real AS (SELECT DISTINCT dataset_id, engine, finding FROM m WHERE expect <> 'trap'),
    j AS (SELECT r.*, real.finding IS NOT NULL AS hit FROM runs r LEFT JOIN real ON real.dataset_id = r.dataset_id AND real.engine = r.engine AND real.finding = r.finding WHERE verdict IN ('Confirmed', 'Doubtful')),
    c AS (SELECT dataset_id, engine, count(DISTINCT id) AS rows_ FROM m WHERE expect <> 'trap' AND verdict = 'Confirmed' GROUP BY ALL),
    k AS (SELECT dataset_id, count(*) AS planted FROM answer_key WHERE expect <> 'trap' GROUP BY ALL)
    SELECT j.dataset_id, j.engine, count(*) FILTER (verdict = 'Confirmed') AS confirmed, count(*) FILTER (verdict = 'Confirmed' AND hit) / count(*) FILTER (verdict = 'Confirmed') AS precision_confirmed,
      coalesce(any_value(c.rows_), 0) / any_value(k.planted) AS recall_confirmed, count(*) FILTER (verdict = 'Doubtful' AND hit) AS real_doubted, count(*) FILTER (verdict = 'Doubtful' AND NOT hit) AS false_alarms_caught
    FROM j JOIN k ON k.dataset_id = j.dataset_id LEFT JOIN c ON c.dataset_id = j.dataset_id AND c.engine = j.engine GROUP BY j.dataset_id, j.engine""")
_ENGINES = ["rules", "model", "tools"]
reg("score_issue", lambda r, k: scoring.per_issue(r, k, _ENGINES), ["runs", "answer_key"], _MATCH + """,
    f AS (SELECT dataset_id, id, """ + ", ".join(f"arg_min(verdict, finding) FILTER (engine = '{e}') AS v_{e}" for e in _ENGINES) + """ FROM m GROUP BY ALL)
    SELECT k.dataset_id, k.id, CASE WHEN expect = 'trap' THEN 'Trap (legitimate)' ELSE 'Problem' END AS kind, clause, source_file, least(line_number, related_line) AS line, """
    + ", ".join(f"CASE WHEN expect = 'trap' THEN CASE WHEN v_{e} IS NULL THEN 'Left alone' ELSE 'FALSE ALARM' END WHEN v_{e} IS NULL THEN 'Missed' WHEN v_{e} = 'Doubtful' THEN 'Found (doubted)' ELSE 'Found' END AS {e}" for e in _ENGINES)
    + " FROM answer_key k LEFT JOIN f ON f.dataset_id = k.dataset_id AND f.id = k.id")
reg("bench_summary", lambda r, k: scoring.summary(scoring.scores(r, k)), ["runs", "answer_key"], _CREDIT + """,
    s AS (SELECT p.dataset_id, p.engine, coalesce(t.true_pos, 0) / p.proposed AS precision, p.proposed - coalesce(t.true_pos, 0) AS false_alarms, coalesce(t.traps_flagged, 0) AS traps_flagged, k.traps, coalesce(c.found, 0) / k.planted AS recall
      FROM (SELECT dataset_id, engine, count(*) AS proposed FROM runs GROUP BY ALL) p JOIN (SELECT dataset_id, count(*) FILTER (expect = 'trap') AS traps, count(*) FILTER (expect <> 'trap') AS planted FROM answer_key GROUP BY ALL) k USING (dataset_id)
      LEFT JOIN (SELECT dataset_id, engine, count(DISTINCT finding) FILTER (expect <> 'trap') AS true_pos, count(DISTINCT id) FILTER (expect = 'trap') AS traps_flagged FROM m GROUP BY ALL) t
        ON t.dataset_id = p.dataset_id AND t.engine = p.engine
      LEFT JOIN (SELECT dataset_id, engine, count(DISTINCT id) AS found FROM credited GROUP BY ALL) c ON c.dataset_id = p.dataset_id AND c.engine = p.engine)
    SELECT engine, count(*) AS runs, avg(recall) AS recall, avg(precision) AS precision, avg(false_alarms) AS false_alarms, CAST(sum(traps_flagged) AS BIGINT) AS traps_flagged, CAST(sum(traps) AS BIGINT) AS traps FROM s GROUP BY engine""")

# ---------------------------------------------------------------- trail
KEY = b"payproof-example-key"
_WORDS = "time || chr(31) || actor || chr(31) || action || chr(31) || finding || chr(31) || detail"
reg("au_append", lambda t: trail.append(t).select("dataset_id", "seq", "prev", "hash"), ["trail"], f"""
    WITH n AS (SELECT dataset_id, seq, {_WORDS} AS words, row_number() OVER (PARTITION BY dataset_id ORDER BY seq) AS k FROM trail),
    c(dataset_id, k, seq, prev, hash) AS (SELECT dataset_id, k, seq, repeat('0', 64), sha256(repeat('0', 64) || words) FROM n WHERE k = 1
      UNION ALL SELECT n.dataset_id, n.k, n.seq, c.hash, sha256(c.hash || n.words) FROM c JOIN n ON n.dataset_id = c.dataset_id AND n.k = c.k + 1)
    SELECT dataset_id, seq, prev, hash FROM c""")


def _tampered(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    log = trail.append(t)
    return log.withColumn("detail", F.when(F.col("seq") % 5003 == 4999, F.concat("detail", F.lit("!"))).otherwise(F.col("detail"))), trail.seals(log, KEY)


reg("au_chain", lambda t: (lambda log, s: trail.verify(log, KEY, s))(*_tampered(t)), ["trail"], """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY seq) - 1 AS pos FROM trail)
    SELECT dataset_id, min(pos) FILTER (seq % 5003 = 4999) AS broken_at, min(pos) FILTER (seq % 5003 = 4999) IS NULL AS intact FROM n GROUP BY dataset_id""")
reg("au_seal", lambda t: trail.seals(trail.append(t), KEY), ["trail"])
_REPLAY = """
WITH s AS (SELECT dataset_id, max(seq) AS started FROM trail WHERE action = 'New run' GROUP BY ALL),
replayed AS (SELECT t.dataset_id, t.finding, arg_max(action, seq) AS status FROM trail t LEFT JOIN s ON s.dataset_id = t.dataset_id
  WHERE action IN ('Approved', 'Rejected', 'Reset to pending') AND (started IS NULL OR seq > started) GROUP BY ALL HAVING arg_max(action, seq) <> 'Reset to pending')"""
reg("au_replay", trail.replay, ["trail"], _REPLAY + " SELECT dataset_id, finding, status FROM replayed")


def _recorded(t: DataFrame) -> DataFrame:
    n = F.substring("finding", 3, 4).cast("int")
    return trail.replay(t).where(n % 11 != 0).withColumn("status", F.when(n % 7 == 0, "Approved").otherwise(F.col("status")))


reg("au_mismatch", lambda t: trail.mismatches(t, _recorded(t)), ["trail"], _REPLAY + """,
    rec AS (SELECT dataset_id, finding, CASE WHEN CAST(substr(finding, 3) AS INT) % 7 = 0 THEN 'Approved' ELSE status END AS recorded FROM replayed WHERE CAST(substr(finding, 3) AS INT) % 11 <> 0)
    SELECT coalesce(a.dataset_id, b.dataset_id) AS dataset_id, coalesce(a.finding, b.finding) AS finding, a.status AS logged, b.recorded
    FROM replayed a FULL JOIN rec b ON a.dataset_id = b.dataset_id AND a.finding = b.finding WHERE a.status IS DISTINCT FROM b.recorded""")
reg("au_sod", lambda t, d: trail.own_run_decisions(t, d).select("dataset_id", "finding", "decided_by"), ["trail", "decisions"], """
    WITH s AS (SELECT dataset_id, regexp_extract(arg_max(actor, seq), '\\((.*)\\)', 1) AS started_by FROM trail WHERE action = 'New run' GROUP BY dataset_id)
    SELECT d.dataset_id, d.finding, d.decided_by FROM decisions d JOIN s ON s.dataset_id = d.dataset_id AND s.started_by = d.decided_by""")
reg("set_trail", trail.full_trail, ["findings", "trail"], """
    SELECT dataset_id, 0 AS part, area || ' agent' AS actor, 'Proposed' AS action, CAST(finding AS VARCHAR) AS finding, title AS detail FROM findings
    UNION ALL SELECT dataset_id, 1, 'Skeptic', 'Verdict: ' || verdict, CAST(finding AS VARCHAR), reason FROM findings
    UNION ALL SELECT dataset_id, 2, actor, action, finding, detail FROM trail""")


def _latest_events(spark: SparkSession, folder: str) -> DataFrame:
    log = bridge.view(spark, folder, "trail").select(F.lit(0).alias("source"), F.col("seq").alias("n"), "actor", F.col("detail").alias("event"))
    stored = bridge.table(spark, folder, "events").select(F.lit(1).alias("source"), F.col("event_id").alias("n"), F.concat(F.lit("user"), "user_id").alias("actor"),
                                                         F.col("event_type").alias("event"))
    return log.unionByName(stored).orderBy("source", F.desc("n")).limit(8)


register("set_events", _latest_events, with_views(["trail"], """SELECT * FROM (SELECT 0 AS source, seq AS n, actor, detail AS event FROM trail
    UNION ALL SELECT 1, event_id, 'user' || CAST(user_id AS VARCHAR), event_type FROM events) ORDER BY source, n DESC LIMIT 8"""))

# ---------------------------------------------------------------- patterns
_AMTS = ["payments", "approvals", "expenses"]
_AMOUNTS = """WITH amounts AS (SELECT * FROM (SELECT dataset_id, source_file, paid_amount AS amount FROM payments UNION ALL SELECT dataset_id, source_file, amount FROM approvals
  UNION ALL SELECT dataset_id, source_file, amount FROM expenses) WHERE amount > 0)"""
reg("benford", lambda p, a, e: patterns.benford(patterns.amounts(p, a, e), ["source_file"]), _AMTS, _AMOUNTS + ",\n d AS (SELECT *, CAST(substr(format('{:.10e}', CAST(amount AS DOUBLE)), 1, 1) AS INTEGER) AS digit FROM amounts WHERE amount >= 1),\n g AS (SELECT source_file, count(*) AS n, log10(CAST(max(amount) AS DOUBLE) / CAST(min(amount) AS DOUBLE)) AS sp, "
    + ", ".join(f"count(*) FILTER (digit = {d}) AS d{d}" for d in range(1, 10)) + " FROM d GROUP BY source_file),\n m AS (SELECT *, ("
    + " + ".join(f"abs(d{d} / n - log10(1 + 1.0 / {d}))" for d in range(1, 10)) + """) / 9 AS raw FROM g)
    SELECT source_file, n, """ + ", ".join(f"d{d}" for d in range(1, 10)) + """, round(raw, 4) AS mad, round(sp, 1) AS span, n >= 300 AND sp >= 2 AS usable,
      CASE WHEN raw < 0.006 THEN 'close conformity' WHEN raw < 0.012 THEN 'acceptable conformity' WHEN raw < 0.015 THEN 'marginal conformity' ELSE 'nonconformity - worth a closer look' END AS verdict FROM m""")
reg("round_share", lambda p, a, e: patterns.round_share(patterns.amounts(p, a, e).where("source_file <> 'expenses.csv'").union(
    patterns.amounts(p, a, e).where("amount >= 500").withColumn("amount", (F.round(F.col("amount") / 100, 0) * 100).cast("decimal(18,4)")).where("CAST(amount AS BIGINT) % 700 = 0")), ["dataset_id"]), _AMTS, _AMOUNTS + """,
    x AS (SELECT dataset_id, amount FROM amounts WHERE source_file <> 'expenses.csv' UNION ALL SELECT dataset_id, round(amount / 100, 0) * 100 AS amount FROM amounts WHERE amount >= 500 AND CAST(round(amount / 100, 0) * 100 AS BIGINT) % 700 = 0)
    SELECT dataset_id, count(*) AS n, count(*) FILTER (amount % 100 = 0) AS round_n, count(*) FILTER (amount % 100 = 0) / count(*) AS share FROM x WHERE amount >= 500 GROUP BY dataset_id""")
reg("bunching", lambda p, a, e: patterns.bunching(patterns.amounts(p, a, e), L, ["dataset_id"]), _AMTS, _AMOUNTS + """,
    t(limit_name, source_file, lim) AS (VALUES ('purchase-order limit', 'approvals.csv', 2500), ('director limit', 'approvals.csv', 10000), ('receipt limit', 'expenses.csv', 25)),
    d AS (SELECT DISTINCT dataset_id FROM amounts),
    c AS (SELECT d.dataset_id, t.limit_name, CAST(t.lim AS DOUBLE) AS limit_amount, count(*) FILTER (a.amount BETWEEN t.lim * 0.96 AND t.lim) AS below, count(*) FILTER (a.amount > t.lim AND a.amount <= t.lim * 1.04) AS above
      FROM d CROSS JOIN t LEFT JOIN amounts a ON a.dataset_id = d.dataset_id AND a.source_file = t.source_file GROUP BY ALL)
    SELECT *, below >= 3 AND below >= 3 * greatest(above, 1) AS flag FROM c""")


def _claims(findings: DataFrame) -> DataFrame:
    return findings.where("area = 'Payments' AND severity = 'High' AND amount > 0").select(F.col("entity").alias("supplier"), F.col("amount").alias("claim"))


reg("recovery_total", lambda f: patterns.recovery(_claims(f)).withColumn("claim", F.col("claim").cast("double")), ["findings"], """
    SELECT entity AS supplier, CAST(sum(amount) AS DOUBLE) AS claim, count(*) AS claims FROM findings WHERE area = 'Payments' AND severity = 'High' AND amount > 0 GROUP BY ROLLUP (entity)""")


def _tools(spark: SparkSession, folder: str) -> DataFrame:
    return bridge.table(spark, folder, "part").selectExpr(
        "p_name AS tool", "p_size * 3 AS licences", "p_size * (p_partkey % 4) AS active_90d", "p_size * 100 AS annual_cost",
        "CASE p_partkey % 3 WHEN 0 THEN 'Cancel' WHEN 1 THEN 'Reduce' ELSE 'Keep' END AS proposed_action", "p_size * 20 AS saving")


register("subs_summary", lambda spark, folder: patterns.subscriptions(_tools(spark, folder)), """
    SELECT CASE p_partkey % 3 WHEN 0 THEN 'Cancel' WHEN 1 THEN 'Reduce' ELSE 'Keep' END AS proposed_action, count(*) AS tools, CAST(sum(p_size * 3) AS BIGINT) AS licences,
      CAST(sum(p_size * 3 - p_size * (p_partkey % 4)) AS BIGINT) AS idle, round_even(100.0::DOUBLE * sum(p_size * (p_partkey % 4)) / sum(p_size * 3), 0) AS active_pct,
      CAST(sum(CASE p_partkey % 3 WHEN 0 THEN p_size * 100 WHEN 1 THEN p_size * 20 ELSE 0 END) AS BIGINT) AS saving FROM part GROUP BY 1""")

# ---------------------------------------------------------------- looking things up
reg("flt_find_text", lambda n: search.find_text(n, "AI AUDITOR").select("dataset_id", "source_file", "line_number"), ["lines"],
    "SELECT dataset_id, source_file, line_number FROM lines WHERE contains(lower(text), 'ai auditor')")


def _found_rows(a: DataFrame) -> DataFrame:
    """How many approvals each kind of condition finds."""
    asked = [("eq", "type", "po"), ("ne", "type", "po"), ("gt", "amount", "9000"), ("lt", "amount", "3000"), ("contains", "vendor", "LIGHT"), ("empty", "po_no", ""),
             ("not_empty", "po_no", ""), ("weekend", "date", "")]
    t = a.select("dataset_id", *[F.col(c).cast("string").alias(c) for c in ("type", "amount", "vendor", "po_no", "date")])
    return t.groupBy("dataset_id").agg(*[F.count_if(search.test(F.col(c), op, v)).alias(f"n_{op}") for op, c, v in asked])


reg("flt_find_rows", _found_rows, ["approvals"], """
    SELECT dataset_id, count(*) FILTER (lower(type) = 'po') AS n_eq, count(*) FILTER (lower(type) <> 'po') AS n_ne, count(*) FILTER (amount > 9000) AS n_gt, count(*) FILTER (amount < 3000) AS n_lt,
      count(*) FILTER (contains(lower(vendor), 'light')) AS n_contains, count(*) FILTER (po_no = '') AS n_empty, count(*) FILTER (po_no <> '') AS n_not_empty, count(*) FILTER (isodow(date) >= 6) AS n_weekend
    FROM approvals GROUP BY dataset_id""")
reg("flt_find_page", lambda a: search.page(a.where(search.test(F.col("vendor"), "contains", "light"))).select("dataset_id", "line_number", "vendor"), ["approvals"],
    "SELECT dataset_id, line_number, vendor FROM approvals WHERE contains(lower(vendor), 'light') ORDER BY dataset_id, source_file, line_number LIMIT 40")
reg("flt_get_lines", lambda n, f: search.get_lines(n, f).select("dataset_id", "source_file", "line_number", "text"), ["lines", "findings"], """
    SELECT dataset_id, source_file, line_number, text FROM lines l WHERE EXISTS (SELECT 1 FROM findings f WHERE f.dataset_id = l.dataset_id AND f.source_file = l.source_file AND f.line_number = l.line_number)""")
reg("flt_describe", search.describe, ["lines"], """
    SELECT dataset_id, source_file, count(*) AS rows, min(line_number) AS first_line, max(line_number) AS last_line, string_agg(text, chr(10) ORDER BY line_number) FILTER (place <= 5) AS first_rows
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, source_file ORDER BY line_number) AS place FROM lines) GROUP BY ALL""")
reg("agg_duplicates", lambda e: search.duplicates(e, ["employee", "receipt_ref"]), ["expenses"], """
    SELECT dataset_id, lower(trim(employee)) AS employee, lower(trim(receipt_ref)) AS receipt_ref, count(*) AS rows, min(line_number) AS first_line, max(line_number) AS last_line FROM expenses
    WHERE trim(employee) <> '' AND trim(receipt_ref) <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1""")
reg("flt_line_chunks", lambda a: search.chunks(a, a.groupBy("dataset_id", "source_file").agg(F.lit("record_id,type,...").alias("header"))).select(
    "dataset_id", "chunk", "lines", F.md5("body").alias("body_md5")), ["approvals"], """
    SELECT dataset_id, (line_number - 1) // 120 AS chunk, count(*) AS lines, md5(CASE WHEN (line_number - 1) // 120 > 0 THEN '(file header) record_id,type,...' || chr(10) ELSE '' END
      || string_agg(CAST(line_number AS VARCHAR) || chr(9) || text, chr(10) ORDER BY line_number)) AS body_md5 FROM approvals GROUP BY dataset_id, (line_number - 1) // 120""")
