"""Payment gate, contract and invoice checks as registered queries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.operators import documents, gate
from payproof.plans.registry import check, o_finding, o_fmt, o_key, o_link, o_list, o_norm, over_views, register, with_views
from payproof.scale import checkpointed
from payproof.sources import textfiles

VIEWS = ["payment_run", "vendors", "approvals", "payments"]


def cleared_holds(decisions: DataFrame) -> DataFrame:
    """Test decisions: a person cleared every hold whose line number ends in 7."""
    return (decisions.where("decision = 'HOLD' AND line_number % 10 = 7")
            .select("dataset_id", "line", F.lit("confirmed by phone").alias("clear_reason")))


def _with_cleared(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both are read from one table: the lines are decided once."""
    decisions = checkpointed(decisions)
    return decisions, cleared_holds(decisions)


def _final(decisions: DataFrame) -> DataFrame:
    return gate.final_decision(*_with_cleared(decisions))


_YES = o_list(S.YES)
_GATE = f"""
WITH run AS (SELECT *, {o_norm('supplier')} AS sup, upper(trim(vendor_id)) AS run_id, trim(invoice) AS inv, {o_key('trim(invoice)')} AS key FROM payment_run),
v AS (SELECT *, upper(trim(vendor_id)) AS vid, {o_norm('name')} AS v_name, min(line_number) OVER (PARTITION BY dataset_id, upper(trim(vendor_id))) AS first_line FROM vendors
      QUALIFY row_number() OVER (PARTITION BY dataset_id, upper(trim(vendor_id)) ORDER BY line_number DESC) = 1),
named AS (SELECT dataset_id, v_name, count(*) AS fits, min(vid) AS only_id, string_agg(vendor_id, ', ' ORDER BY first_line) AS fit_ids FROM v GROUP BY dataset_id, v_name),
r1 AS (SELECT r.*, n.fits, n.fit_ids, CASE WHEN run_id <> '' THEN run_id WHEN sup <> '' AND n.fits = 1 THEN n.only_id END AS rvid
       FROM run r LEFT JOIN named n ON n.dataset_id = r.dataset_id AND n.v_name = r.sup),
r2 AS (SELECT r.*, v.vendor_id AS m_id, v.name AS m_name, v.v_name, v.status AS m_status, v.bank_acct, v.bank_changed_on, v.bank_verified, v.created_on,
         coalesce(rvid, '') AS vid, v.vid IS NOT NULL AS known, v.vid IS NOT NULL AND run_id <> '' AND v.v_name <> sup AS differs
       FROM r1 r LEFT JOIN v ON v.dataset_id = r.dataset_id AND v.vid = r.rvid),
a AS (SELECT *, {o_key('doc_no')} AS key, {o_norm('vendor')} AS vk FROM approvals WHERE upper(trim(type)) IN ({o_list(S.INVOICE_TYPES)}) AND trim(doc_no) <> ''),
ranked AS (SELECT r.dataset_id, r.line_number, a.line_number AS a_line, a.vk, a.amount AS a_amount, a.approved_by,
             row_number() OVER (PARTITION BY r.dataset_id, r.line_number ORDER BY
               CASE WHEN a.vk = r.sup OR a.vk = r.v_name THEN CASE WHEN trim(a.approved_by) <> '' THEN 0 ELSE 1 END ELSE 2 END,
               CASE WHEN a.vk = r.sup OR a.vk = r.v_name THEN -a.line_number ELSE a.line_number END) AS best
           FROM r2 r JOIN a ON a.dataset_id = r.dataset_id AND a.key = r.key WHERE r.inv <> ''),
p AS (SELECT dataset_id, {o_key('invoice_no')} AS key, upper(trim(vendor_id)) AS pid, {o_norm('supplier')} AS pname FROM payments WHERE trim(invoice_no) <> ''),
paid AS (SELECT DISTINCT r.dataset_id, r.line_number FROM r2 r JOIN p ON p.dataset_id = r.dataset_id AND p.key = r.key
         WHERE r.inv <> '' AND CASE WHEN pid <> '' AND vid <> '' THEN pid = vid ELSE pname = sup OR pname = v_name END),
again AS (SELECT DISTINCT r.dataset_id, r.line_number FROM r2 r JOIN r2 o ON o.dataset_id = r.dataset_id AND o.key = r.key AND o.line_number < r.line_number
          WHERE CASE WHEN o.vid <> '' AND r.vid <> '' THEN o.vid = r.vid ELSE o.sup = r.sup OR o.v_name = r.sup OR o.sup = r.v_name OR o.v_name = r.v_name END),
x AS (SELECT r.*, k.a_line, k.vk, k.a_amount, k.approved_by, paid.line_number IS NOT NULL AS is_paid, again.line_number IS NOT NULL AS is_again,
        trim(bank_last4) AS last4, coalesce(trim(bank_acct), '') AS on_file, coalesce(trim(bank_changed_on), '') AS changed,
        CASE WHEN trim(line) = '' THEN CAST(r.line_number - 1 AS VARCHAR) ELSE trim(line) END AS label
      FROM r2 r LEFT JOIN ranked k ON k.dataset_id = r.dataset_id AND k.line_number = r.line_number AND k.best = 1
      LEFT JOIN paid ON paid.dataset_id = r.dataset_id AND paid.line_number = r.line_number
      LEFT JOIN again ON again.dataset_id = r.dataset_id AND again.line_number = r.line_number),
f AS (SELECT *, NOT known OR (trim(m_status) <> '' AND NOT starts_with(upper(trim(m_status)), 'ACTIVE')) AS f1,
        a_line IS NULL OR trim(approved_by) = '' AS f2, (a_line IS NOT NULL AND vk <> sup) OR differs AS f3, is_paid AS f4, is_again AS f5,
        amount <= 0 OR coalesce(amount > a_amount + 0.005, false) AS f6,
        known AND changed <> '' AND upper(trim(bank_verified)) NOT IN ({_YES}) AND changed <> trim(created_on) AS f7,
        known AND last4 <> '' AND on_file <> '' AND right(on_file, 4) <> right(last4, 4) AS f8,
        row_number() OVER (PARTITION BY dataset_id, label ORDER BY line_number) AS nth FROM x),
g AS (SELECT dataset_id, line_number, CASE WHEN nth = 1 THEN label ELSE label || ' (row ' || CAST(line_number - 1 AS VARCHAR) || ')' END AS line, supplier, inv AS invoice, amount,
        list_filter([CASE WHEN f1 THEN 1 END, CASE WHEN f2 THEN 2 END, CASE WHEN f3 THEN 3 END, CASE WHEN f4 THEN 4 END, CASE WHEN f5 THEN 5 END,
                     CASE WHEN f6 THEN 6 END, CASE WHEN f7 THEN 7 END, CASE WHEN f8 THEN 8 END], lambda i: i IS NOT NULL) AS failed,
        list_filter([CASE WHEN f1 THEN CASE WHEN run_id = '' AND sup <> '' AND fits > 1 THEN trim(supplier) || ' matches ' || CAST(fits AS VARCHAR) || ' vendors (' || fit_ids || '); add the vendor id to the run' ELSE '{S.GATE_REASONS[1]}' END END,
                     CASE WHEN f2 THEN '{S.GATE_REASONS[2]}' END,
                     CASE WHEN f3 THEN CASE WHEN differs THEN 'Vendor ' || m_id || ' is ' || trim(m_name) || ', not ' || trim(supplier) ELSE '{S.GATE_REASONS[3]}' END END,
                     CASE WHEN f4 THEN '{S.GATE_REASONS[4]}' END, CASE WHEN f5 THEN '{S.GATE_REASONS[5]}' END,
                     CASE WHEN f6 THEN CASE WHEN amount <= 0 THEN 'Amount "' || trim(amount_text) || '" is missing, zero or negative' ELSE '{S.GATE_REASONS[6]}' END END,
                     CASE WHEN f7 THEN '{S.GATE_REASONS[7]}' END, CASE WHEN f8 THEN '{S.GATE_REASONS[8]}' END], lambda s: s IS NOT NULL) AS said,
        CASE WHEN (last4 <> '' AND on_file <> '') OR NOT known THEN 'All 8 checks passed'
             WHEN last4 = '' THEN '7 of 8 checks passed; the run gives no bank account, so it is paid to the account on file'
             ELSE '7 of 8 checks passed; the vendor master has no bank account to compare with' END AS passed,
        CASE WHEN known AND last4 <> '' AND on_file = '' THEN '; bank account not compared: the vendor master has none' ELSE '' END AS tail, m_id, a_line,
        f1, f2, f3, f4, f5, f6, f7, f8 FROM f),
decided AS (SELECT *, CASE WHEN len(failed) > 0 THEN 'HOLD' ELSE 'RELEASE' END AS decision,
        CASE WHEN len(failed) > 0 THEN array_to_string(said, '; ') || tail ELSE passed END AS reason,
        CASE WHEN len(failed) > 0 THEN array_to_string(failed, ',') ELSE '-' END AS failed_checks FROM g),
final AS (SELECT *, CASE WHEN decision = 'HOLD' AND line_number % 10 = 7 THEN 'RELEASE (hold cleared)' ELSE decision END AS final_decision FROM decided)"""


def gate_query(name: str, fn, sql: str | None) -> None:
    register(name, over_views(lambda r, v, a, p: fn(gate.evaluate(r, v, a, p)), VIEWS), with_views(VIEWS, _GATE + sql) if sql else None)


gate_query("gate_vendor", lambda d: d.select("dataset_id", "line_number", "matched_vendor"), " SELECT dataset_id, line_number, m_id AS matched_vendor FROM decided")
gate_query("gate_approval", lambda d: d.select("dataset_id", "line_number", "approval_line"), " SELECT dataset_id, line_number, a_line AS approval_line FROM decided")
for _i in gate.CHECKS:
    gate_query(f"gate_c{_i}", lambda d, i=_i: d.select("dataset_id", "line_number", F.col(f"c{i}").alias("passed")),
               f" SELECT dataset_id, line_number, CASE WHEN f{_i} THEN 0 ELSE 1 END AS passed FROM decided")
gate_query("gate_reason", lambda d: d.select("dataset_id", "line", "supplier", "invoice", F.col("amount").cast("double").alias("amount"), "decision", "reason", "failed_checks"),
           " SELECT dataset_id, line, supplier, invoice, CAST(amount AS DOUBLE) AS amount, decision, reason, failed_checks FROM decided")
gate_query("gate_final", lambda d: _final(d).select("dataset_id", "line", "final_decision"),
           " SELECT dataset_id, line, final_decision FROM final")
gate_query("gate_totals", lambda d: gate.totals(*_with_cleared(d)).select(
    "dataset_id", "lines", "vendors", "hold_n", "rel_n", "cleared_n", *[F.col(c).cast("double").alias(c) for c in ("total", "hold_amt", "rel_amt")]),
    """ SELECT dataset_id, count(*) AS lines, count(DISTINCT supplier) AS vendors, count(*) FILTER (final_decision = 'HOLD') AS hold_n,
          count(*) FILTER (final_decision <> 'HOLD') AS rel_n, count(*) FILTER (decision = 'HOLD' AND final_decision <> 'HOLD') AS cleared_n,
          CAST(sum(greatest(amount, 0)) AS DOUBLE) AS total, CAST(coalesce(sum(greatest(amount, 0)) FILTER (final_decision = 'HOLD'), 0) AS DOUBLE) AS hold_amt,
          CAST(coalesce(sum(greatest(amount, 0)) FILTER (final_decision <> 'HOLD'), 0) AS DOUBLE) AS rel_amt FROM final GROUP BY dataset_id""")
gate_query("snk_release", lambda d: gate.release_list(_final(d)).withColumn("amount", F.col("amount").cast("double")),
           " SELECT dataset_id, line, supplier, invoice, CAST(amount AS DOUBLE) AS amount FROM final WHERE final_decision <> 'HOLD'")

# ---------------------------------------------------------------- contracts
L = S.LIMITS


def _rec(kind: str) -> str:
    return (f"SELECT dataset_id, line_number, parts[1] AS ref, trim(parts[2]) AS vendor, parts[3] AS place, parts[4] AS body, {o_norm('parts[2]')} AS vendor_key FROM ("
            f"SELECT *, [regexp_extract(text, p, 1), regexp_extract(text, p, 2), regexp_extract(text, p, 3), regexp_extract(text, p, 4)] AS parts "
            f"FROM (SELECT *, '^\\[{kind} (\\S+) \\| ([^|]+?) \\| ([^\\]]+)\\] (.*)' AS p FROM contract_lines) WHERE starts_with(text, '[{kind} '))")


_CON = f"WITH con AS ({_rec('CONTRACT')}), bil AS ({_rec('INVOICE')}), amt AS (SELECT *, CAST(replace(regexp_extract(body, '([0-9][0-9,]*\\.[0-9]{{2}})\\s*$', 1), ',', '') AS DECIMAL(18,4)) AS amount FROM bil)"
_PAIR = "FROM amt b JOIN con c ON c.dataset_id = b.dataset_id AND c.vendor_key = b.vendor_key"


def _contract(name: str, fn, clause: str, severity: str, amount: str, title: str, where: str) -> None:
    fields = o_finding(clause, severity, amount, title, 'contracts.txt', 'b.line_number', 'c.line_number').replace('dataset_id,', 'b.dataset_id,', 1)
    links = o_link(clause, 'contracts.txt', 'b.line_number', 'c.line_number', 'c.line_number').replace('dataset_id,', 'b.dataset_id,', 1)
    check(name, fn, ["contract_lines"], L, f"{_CON} SELECT {fields} {_PAIR} WHERE {where}", f"{_CON} SELECT {links} {_PAIR} WHERE {where}")


register("src_text_records", over_views(lambda t: textfiles.records(t, "CONTRACT").union(textfiles.records(t, "INVOICE")), ["contract_lines"]),
         with_views(["contract_lines"], f"{_CON} SELECT * FROM con UNION ALL SELECT * FROM bil"))
_contract("chk_7_1", documents.excluded_charge, "7.1", "Medium", "amount", f"b.ref || ' adds a $' || {o_fmt('amount')} || ' charge the contract does not allow'",
          "contains(lower(b.body), 'surcharge') AND regexp_matches(c.body, '(?i)surcharge.*excluded|not listed|may not be billed')")
_RC, _RI, _H = "regexp_extract(c.body, '(?i)rate is [$]?([0-9.]+) per hour', 1)", "regexp_extract(b.body, '(?i)at [$]?([0-9.]+) per hour', 1)", "regexp_extract(b.body, '([0-9]+) hours', 1)"
_contract("chk_7_2", documents.rate_above_contract, "7.2", "High", f"(CAST({_RI} AS DECIMAL(11,4)) - CAST({_RC} AS DECIMAL(11,4))) * CAST({_H} AS DECIMAL(11,0))",
          f"b.vendor || ' billed ' || {_RI} || ' per hour against a contracted ' || {_RC}",
          f"{_RC} <> '' AND {_RI} <> '' AND {_H} <> '' AND TRY_CAST({_RI} AS DECIMAL(11,4)) > TRY_CAST({_RC} AS DECIMAL(11,4))")
_contract("chk_7_3", documents.after_contract_end, "7.3", "Medium", "amount", "b.vendor || ' billed for service after the contract ended'",
          "TRY_CAST(regexp_extract(b.body, 'Service period [0-9-]+ to ([0-9-]+)', 1) AS DATE) > TRY_CAST(regexp_extract(c.body, '(?i)ends on ([0-9-]{10})', 1) AS DATE)")
_contract("chk_7_4", documents.silent_renewal, "7.4", "Low", "amount", "b.vendor || ' auto-renewed with no cancellation decision on file'",
          "contains(lower(c.body), 'auto-renews') AND contains(lower(b.body), 'no notice of cancellation')")

# ---------------------------------------------------------------- scanned invoices
# in these views an invoice is a document of eight lines, so the oracle can find its fields by position and wording
_BLOCKS = """
WITH doc AS (SELECT *, max(line_number) FILTER (WHERE starts_with(text, '[PDF ')) OVER (PARTITION BY dataset_id ORDER BY line_number) AS start FROM invoice_lines),
inv AS (SELECT dataset_id, start, max(regexp_extract(text, '^\\[PDF (.+)\\]$', 1)) FILTER (line_number = start) AS name,
   min(line_number) FILTER (starts_with(text, 'Invoice No:')) AS number_line, max(substr(text, 13)) FILTER (starts_with(text, 'Invoice No:')) AS number,
   min(line_number) FILTER (starts_with(text, 'Total due:')) AS total_line, max(regexp_extract(text, '\\$([0-9.]+)', 1)) FILTER (starts_with(text, 'Total due:')) AS total,
   min(line_number) FILTER (starts_with(text, 'Pay to account:')) AS bank_line, max(regexp_extract(text, '([0-9]+)$', 1)) FILTER (starts_with(text, 'Pay to account:')) AS bank,
   min(line_number) FILTER (starts_with(text, 'From:')) AS vendor_line, max(trim(substr(text, 6))) FILTER (starts_with(text, 'From:')) AS vendor,
   start + 1 AS guess_line, max(text) FILTER (line_number = start + 1) AS guess FROM doc GROUP BY dataset_id, start)"""
register("src_invoice_blocks", over_views(textfiles.invoice_blocks, ["invoice_lines"]), with_views(["invoice_lines"], _BLOCKS + " SELECT * FROM inv"))

_READ = _BLOCKS + f""",
said AS (SELECT *, {o_norm('coalesce(vendor, guess)')} AS name_key, {o_key('number')} AS inv_key, coalesce(TRY_CAST(total AS DECIMAL(18,4)), 0) AS amount FROM inv),
master AS (SELECT dataset_id, {o_norm('name')} AS key, arg_max(vendor_id, line_number) AS vendor_id, arg_max(bank_acct, line_number) AS bank_acct FROM vendors GROUP BY ALL),
near AS (SELECT s.dataset_id, s.start, count(*) AS n, bool_or(m.key = s.name_key) AS exact, min(m.key) AS only_key FROM said s JOIN master m ON m.dataset_id = s.dataset_id AND m.key <> '' AND s.name_key <> ''
         AND (m.key = s.name_key OR starts_with(m.key, s.name_key || ' ') OR starts_with(s.name_key, m.key || ' ')) GROUP BY ALL),
known AS (SELECT s.*, m.vendor_id, m.bank_acct FROM said s LEFT JOIN near n ON n.dataset_id = s.dataset_id AND n.start = s.start
          LEFT JOIN master m ON m.dataset_id = s.dataset_id AND m.key = CASE WHEN n.exact THEN s.name_key WHEN n.n = 1 THEN n.only_key END),
who AS (SELECT *, coalesce(vendor_id, CASE WHEN vendor IS NOT NULL THEN {o_norm('vendor')} END, '') AS who FROM known)"""
_INVOICE_VIEWS = ["invoice_lines", "vendors", "approvals"]
_APPROVED = _READ + f""",
a AS (SELECT dataset_id, line_number, amount, {o_key('doc_no')} AS inv_key, {o_norm('vendor')} AS vk FROM approvals WHERE upper(trim(type)) IN ({o_list(S.INVOICE_TYPES)})),
best AS (SELECT w.dataset_id, w.start, a.amount AS approved, row_number() OVER (PARTITION BY w.dataset_id, w.start ORDER BY (a.vk = w.name_key) DESC, a.line_number) AS k
         FROM who w JOIN a ON a.dataset_id = w.dataset_id AND a.inv_key = w.inv_key),
x AS (SELECT w.*, b.approved FROM who w LEFT JOIN best b ON b.dataset_id = w.dataset_id AND b.start = w.start AND b.k = 1)"""
_OFF = "total IS NOT NULL AND abs(amount - approved) > 0.005"
check("chk_8_1", documents.not_approved, _INVOICE_VIEWS, L, _APPROVED + f"""
      SELECT {o_finding('8.1', 'Medium', 'CASE WHEN approved IS NULL THEN amount ELSE abs(amount - approved) END', f"CASE WHEN approved IS NULL THEN 'Invoice ' || number || ' (' || name || ') has no approval record' ELSE 'Invoice ' || number || ' total $' || {o_fmt('amount')} || ' differs from the approved $' || {o_fmt('approved')} END", 'invoices.txt', 'CASE WHEN approved IS NULL THEN number_line ELSE total_line END')}
      FROM x WHERE approved IS NULL OR ({_OFF})""", _APPROVED + f" SELECT {o_link('8.1', 'invoices.txt', 'total_line', 'number_line')} FROM x WHERE approved IS NOT NULL AND {_OFF}")
_OTHER_BANK = "bank IS NOT NULL AND vendor_id IS NOT NULL AND right(regexp_replace(bank_acct, '[^0-9]', '', 'g'), 4) NOT IN ('', right(bank, 4))"
check("chk_8_2", documents.other_account, ["invoice_lines", "vendors"], L, _READ + f"""
      SELECT {o_finding('8.2', 'High', 'amount', "'Invoice ' || number || ' asks for payment to account ending ' || right(bank, 4) || '; ' || vendor_id || ' is on file with ' || right(regexp_replace(bank_acct, '[^0-9]', '', 'g'), 4)", 'invoices.txt', 'bank_line')}
      FROM who WHERE {_OTHER_BANK}""", _READ + f" SELECT {o_link('8.2', 'invoices.txt', 'bank_line', 'number_line')} FROM who WHERE {_OTHER_BANK}")
_PRIOR = _READ + """,
prior AS (SELECT w.*, (SELECT min(o.number_line) FROM who o WHERE o.dataset_id = w.dataset_id AND o.inv_key = w.inv_key AND o.number_line < w.number_line
                       AND NOT (o.who <> '' AND w.who <> '' AND o.who <> w.who)) AS earlier FROM who w)"""
check("chk_8_3", documents.submitted_again, ["invoice_lines", "vendors"], L, _PRIOR + f"""
      SELECT {o_finding('8.3', 'High', 'amount', "'Invoice ' || number || ' was submitted twice (' || name || ')'", 'invoices.txt', 'number_line')} FROM prior WHERE earlier IS NOT NULL""",
      _PRIOR + f" SELECT {o_link('8.3', 'invoices.txt', 'number_line', 'earlier')} FROM prior WHERE earlier IS NOT NULL")
