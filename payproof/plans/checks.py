"""The policy checks as registered queries."""
from __future__ import annotations

from payproof import schema as S
from payproof.functions import screens
from payproof.operators import approvals, expenses, payments, vendors
from payproof.plans.registry import (ORACLES, check, o_finding, o_fmt, o_key, o_link, o_list, o_norm, o_parts, o_person, o_same, over_views,
                                     register, with_views)

L = S.LIMITS

# ---------------------------------------------------------------- payments
PAYEE = f"""
WITH named AS (SELECT *, {o_norm('supplier')} AS payee_name, upper(trim(vendor_id)) AS own_id FROM payments),
ids AS (SELECT dataset_id, payee_name, min(own_id) AS only_id FROM named WHERE own_id <> ''
        GROUP BY dataset_id, payee_name HAVING count(DISTINCT own_id) = 1),
ref0 AS (SELECT n.*, CASE WHEN own_id <> '' THEN own_id ELSE coalesce(ids.only_id, n.payee_name) END AS payee
         FROM named n LEFT JOIN ids USING (dataset_id, payee_name)),
refd AS (SELECT *, trim(invoice_no) AS inv, {o_key('trim(invoice_no)')} AS invoice_key FROM ref0 WHERE trim(invoice_no) <> ''),
w AS (SELECT *, arg_min(invoice_amount, (pay_date, line_number)) FILTER (WHERE invoice_amount > 0) OVER g AS first_amount,
        min((pay_date, line_number)) FILTER (WHERE paid_amount > 0) OVER g AS first_pos,
        sum(paid_amount) OVER g AS net_all,
        sum(paid_amount) OVER (g ORDER BY pay_date, line_number ROWS UNBOUNDED PRECEDING) AS net,
        count(*) FILTER (WHERE paid_amount > 0) OVER (g ORDER BY pay_date, line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS paid_before
      FROM refd WINDOW g AS (PARTITION BY dataset_id, payee, invoice_key))"""

register("jn_payee", over_views(lambda p: payments.with_payee(p).select("dataset_id", "line_number", "payee_name", "payee"), ["payments"]),
         with_views(["payments"], f"{PAYEE.split('refd AS')[0].rstrip().rstrip(',')} SELECT dataset_id, line_number, payee_name, payee FROM ref0"))

register("ord_payments", over_views(lambda p: payments.order_of_payment(payments.referenced(p)).select(
    "dataset_id", "payee", "invoice_key", "line_number", "earlier"), ["payments"]),
    with_views(["payments"], PAYEE + """ SELECT dataset_id, payee, invoice_key, line_number,
        row_number() OVER (PARTITION BY dataset_id, payee, invoice_key ORDER BY pay_date NULLS LAST, line_number) - 1 AS earlier FROM refd"""))

_TWICE = "paid_amount > 0 AND paid_before > 0 AND net > coalesce(first_amount, 0) + 1 AND net_all > coalesce(first_amount, 0) + 1"
check("chk_5_2", payments.paid_twice, ["payments"], L,
      PAYEE + f" SELECT {o_finding('5.2', 'High', 'paid_amount', chr(39).join(['upper(inv) || ', ' was paid more than once', '']), 'payments.csv')} FROM w WHERE {_TWICE}",
      PAYEE + f""", paid AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, payee, invoice_key ORDER BY pay_date, line_number) AS nth
        FROM w WHERE paid_amount > 0)
      SELECT {o_link('5.2', 'payments.csv', 'a.line_number', 'b.line_number').replace('dataset_id,', 'a.dataset_id,', 1)}
      FROM paid a JOIN paid b ON a.dataset_id = b.dataset_id AND a.payee = b.payee AND a.invoice_key = b.invoice_key
        AND b.nth BETWEEN a.nth - 10 AND a.nth - 1
      WHERE {_TWICE.replace('paid_amount', 'a.paid_amount').replace('paid_before', 'a.paid_before').replace('first_amount', 'a.first_amount').replace('net ', 'a.net ').replace('net_all', 'a.net_all')}""")

check("chk_5_1", payments.overpaid, ["payments"], L, PAYEE + f""",
      owed AS (SELECT *, CASE WHEN invoice_amount_blank THEN first_amount ELSE invoice_amount END AS owed FROM w
               WHERE paid_amount > 0 AND (pay_date, line_number) = first_pos)
      SELECT {o_finding('5.1', 'Medium', 'paid_amount - owed', f"inv || ' paid $' || {o_fmt('paid_amount')} || ' against an invoice of $' || {o_fmt('owed')}", 'payments.csv')}
      FROM owed WHERE paid_amount > owed + 1""")

check("chk_5_3_noref", payments.no_reference, ["payments"], L, f"""
      SELECT {o_finding('5.3', 'Medium', 'paid_amount', "'Payment to ' || supplier || ' has no invoice reference'", 'payments.csv')}
      FROM payments WHERE paid_amount > 0 AND trim(invoice_no) = ''""")
check("chk_5_3_early", payments.paid_early, ["payments"], L, f"""
      SELECT {o_finding('5.3', 'Low', 'paid_amount', "trim(invoice_no) || ' paid before the invoice date'", 'payments.csv')}
      FROM payments WHERE paid_amount > 0 AND trim(invoice_no) <> '' AND pay_date < invoice_date""")
check("chk_5_4", payments.weekend_release, ["payments"], L, f"""
      SELECT {o_finding('5.4', 'Low', 'paid_amount', "'Payment released on a ' || dayname(pay_date)", 'payments.csv')}
      FROM payments WHERE paid_amount > 0 AND isodow(pay_date) >= 6""")


def o_similar(x: str, y: str) -> str:
    """The re-keyed number test, spelt with lists of characters."""
    differ = f"list_filter(range(1, len({x}) + 1), lambda i: substr({x}, i, 1) <> substr({y}, i, 1))"
    num = "TRY_CAST(regexp_extract({0}, '([0-9]+)[^0-9]*$', 1) AS BIGINT)"
    nx, ny = num.format(x), num.format(y)
    return (f"({x} <> '' AND {y} <> '' AND {x} <> {y} AND ("
            f"(least(len({x}), len({y})) >= 4 AND (contains({x}, {y}) OR contains({y}, {x})))"
            f" OR (len({x}) = len({y}) AND len({x}) >= 4 AND CASE WHEN len({differ}) = 2 AND {differ}[2] = {differ}[1] + 1"
            f" AND substr({x}, {differ}[1], 1) = substr({y}, {differ}[2], 1) AND substr({x}, {differ}[2], 1) = substr({y}, {differ}[1], 1)"
            f" THEN coalesce(abs({nx} - {ny}) > 50, true) ELSE translate({x}, 'OILSBZ', '011582') = translate({y}, 'OILSBZ', '011582') END)))")


def o_near(apart: str) -> str:
    return PAYEE + f""",
live AS (SELECT *, regexp_replace(upper(inv), '[^A-Z0-9]', '', 'g') AS keyed, round(paid_amount, 2) AS cents FROM w WHERE paid_amount >= 50 AND net_all > 1),
posd AS (SELECT *, row_number() OVER b AS pos, min(line_number) OVER (PARTITION BY dataset_id, payee, cents, invoice_date) AS bucket_line
         FROM live WINDOW b AS (PARTITION BY dataset_id, payee, cents, invoice_date ORDER BY pay_date, line_number)),
pairs AS (SELECT x.dataset_id, x.payee, least(x.invoice_key, y.invoice_key) AS k1, greatest(x.invoice_key, y.invoice_key) AS k2, x.bucket_line, x.pos AS i, y.pos AS j,
            x.cents, x.supplier, x.line_number AS xl, y.line_number AS yl, x.inv AS xi, y.inv AS yi
          FROM posd x JOIN posd y ON x.dataset_id = y.dataset_id AND x.payee = y.payee AND x.cents = y.cents AND x.invoice_date = y.invoice_date
            AND y.pos - x.pos {apart} AND x.invoice_key <> y.invoice_key
          WHERE {o_similar('x.keyed', 'y.keyed')}
            AND NOT (greatest(x.invoice_amount, y.invoice_amount) <> 0 AND x.cents * 2 <= greatest(x.invoice_amount, y.invoice_amount) + 1)),
one AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY dataset_id, payee, k1, k2 ORDER BY bucket_line, i, j) = 1)"""


_NEAR = o_near("BETWEEN 1 AND 50")
NEAR_WHOLE = ["payments"], f"{o_near('>= 1')} SELECT dataset_id, '5.6' AS clause, greatest(xl, yl) AS line_number FROM one"
register("chk_5_cut", over_views(lambda p: payments.cut_searches(p, L), ["payments"]))
check("chk_5_6", payments.near_duplicates, ["payments"], L, _NEAR + f"""
      SELECT {o_finding('5.6', 'Medium', 'cents', f"CASE WHEN xl < yl THEN xi || ' and ' || yi ELSE yi || ' and ' || xi END || ' look like one invoice paid twice ($' || {o_fmt('cents')} || ' each to ' || trim(supplier) || ')'", 'payments.csv', 'greatest(xl, yl)', 'least(xl, yl)')}
      FROM one""", _NEAR + f" SELECT {o_link('5.6', 'payments.csv', 'greatest(xl, yl)', 'least(xl, yl)', 'least(xl, yl)')} FROM one")

_MASTER = f"""
WITH master AS (SELECT dataset_id, upper(trim(vendor_id)) AS vid, status, status_changed_date FROM vendors
                QUALIFY row_number() OVER (PARTITION BY dataset_id, upper(trim(vendor_id)) ORDER BY line_number DESC) = 1),
names AS (SELECT dataset_id, {o_norm('name')} AS payee_name, count(*) AS records, min(upper(trim(vendor_id))) AS vid FROM vendors GROUP BY ALL),
paid AS (SELECT p.*, {o_norm('supplier')} AS payee_name FROM payments p WHERE paid_amount > 0)"""
check("chk_4_1_cross", payments.vendor_status_at_payment, ["payments", "vendors"], L, _MASTER + f""",
      ided AS (SELECT p.*, CASE WHEN trim(vendor_id) <> '' THEN upper(trim(vendor_id)) WHEN n.records = 1 THEN n.vid ELSE '' END AS pvid
               FROM paid p LEFT JOIN names n USING (dataset_id, payee_name)),
      met AS (SELECT i.*, m.status, m.status_changed_date, m.vid FROM ided i LEFT JOIN master m ON i.dataset_id = m.dataset_id AND i.pvid = m.vid WHERE pvid <> '')
      SELECT {o_finding('4.1', 'Medium', 'paid_amount', "CASE WHEN vid IS NULL THEN payment_id || ' paid vendor ' || pvid || ', which is not in the vendor master' ELSE payment_id || ' paid ' || lower(status) || ' vendor ' || pvid END", 'payments.csv')}
      FROM met WHERE vid IS NULL OR (trim(status) <> '' AND NOT starts_with(upper(trim(status)), 'ACTIVE') AND NOT coalesce(pay_date <= status_changed_date, false))""")
check("chk_4_1_unknown", payments.unknown_payee, ["payments", "vendors"], L, _MASTER + f"""
      SELECT {o_finding('4.1', 'Low', 'paid_amount', "payment_id || ' paid ' || trim(supplier) || ', who has no vendor id and is not in the vendor master'", 'payments.csv')}
      FROM paid p WHERE trim(vendor_id) = '' AND payee_name <> '' AND NOT EXISTS (
        SELECT 1 FROM names n WHERE n.dataset_id = p.dataset_id AND n.payee_name <> '' AND (n.payee_name = p.payee_name
          OR starts_with(n.payee_name, p.payee_name || ' ') OR starts_with(p.payee_name, n.payee_name || ' ')))""")

# ---------------------------------------------------------------- approvals
_LABEL = "CASE WHEN doc_no <> '' THEN doc_no ELSE record_id END"
_INV = f"upper(trim(type)) IN ({o_list(S.INVOICE_TYPES)})"
_HAS_PO = f"upper(trim(po_no)) NOT IN ({o_list(S.NO_PO)})"


def o_director(x: str) -> str:
    left = f"regexp_replace({x}, '(?i)\\b(?:to\\s+(?:the\\s+)?(?:\\w+\\s+)?(?:director|cfo|ceo|chief|managing)|(?:assistant|associate)\\s+(?:\\w+\\s+)?director)\\b', ' ', 'g')"
    return f"regexp_matches({left}, '(?i)\\b(director|cfo|ceo|chief (financial|executive|operating) officer|managing partner)\\b')"


def o_exempt(x: str) -> str:
    full = f"trim(regexp_replace(lower(replace({x}, '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"
    return f"regexp_matches({full}, '" + "|".join(
        "\\b" + "\\s+(and\\s+)?".join(w for w in p.split() if w != "and") + "\\b" for p in S.PO_EXEMPT_WORDS) + "')"


check("chk_1_2", approvals.self_approved, ["approvals"], L, f"""
      WITH parts AS (SELECT *, {o_parts('requested_by')} AS pa, {o_parts('approved_by')} AS pb FROM approvals)
      SELECT {o_finding('1.2', 'High', 'amount', f"{_LABEL} || ' raised and approved by the same person'", 'approvals.csv')} FROM parts WHERE {o_same('pa', 'pb')}""")
check("chk_1_1_nopo", approvals.no_purchase_order, ["approvals"], L, f"""
      SELECT {o_finding('1.1', 'Medium', 'amount', f"{_LABEL} || ' for $' || {o_fmt('amount')} || ' has no purchase order'", 'approvals.csv')}
      FROM approvals WHERE amount > 2500 AND NOT ({_HAS_PO}) AND {_INV} AND NOT {o_exempt('vendor')}""")

_PO = f"""
WITH keyed AS (SELECT *, {o_norm('vendor')} AS vendor_key FROM approvals),
pos AS (SELECT *, lower(trim(doc_no)) AS po_key FROM keyed WHERE upper(trim(type)) = 'PO'),
inv AS (SELECT *, lower(trim(po_no)) AS po_key FROM keyed WHERE {_INV} AND {_HAS_PO}),
cand AS (SELECT i.dataset_id, i.line_number, i.doc_no, i.date, i.amount, i.approver_role, i.record_id, p.line_number AS po_line, p.doc_no AS po_doc, p.date AS po_date,
           p.amount AS po_amount, p.vendor_key = i.vendor_key AS same,
           count(*) OVER (PARTITION BY i.dataset_id, i.line_number) AS n,
           row_number() OVER (PARTITION BY i.dataset_id, i.line_number ORDER BY (p.vendor_key = i.vendor_key) DESC, p.line_number) AS best
         FROM inv i JOIN pos p USING (dataset_id, po_key)),
po AS (SELECT * FROM cand WHERE best = 1 AND (same OR n = 1))"""
check("chk_1_1_late", approvals.late_order, ["approvals"], L, _PO + f"""
      SELECT {o_finding('1.1', 'Medium', 'amount', "po_doc || ' raised ' || CAST(po_date - date AS VARCHAR) || ' days after invoice ' || doc_no", 'approvals.csv', 'po_line', 'line_number')}
      FROM po WHERE po_date > date""", _PO + f" SELECT {o_link('1.1', 'approvals.csv', 'po_line', 'line_number', 'line_number')} FROM po WHERE po_date > date")

_COVERED = _PO + f""",
tries AS (SELECT dataset_id, po_line, line_number, amount, po_amount + 1 AS room, row_number() OVER (PARTITION BY dataset_id, po_line ORDER BY line_number) AS nth
          FROM po WHERE same AND amount > 10000 AND po_amount > 10000 AND NOT {o_director('approver_role')}),
fold(dataset_id, po_line, nth, line_number, billed, taken) AS (
  SELECT dataset_id, po_line, nth, line_number, CAST(CASE WHEN amount <= room THEN amount ELSE 0 END AS DECIMAL(38,4)), amount <= room FROM tries WHERE nth = 1
  UNION ALL
  SELECT t.dataset_id, t.po_line, t.nth, t.line_number, CAST(CASE WHEN f.billed + t.amount <= t.room THEN f.billed + t.amount ELSE f.billed END AS DECIMAL(38,4)),
         f.billed + t.amount <= t.room
  FROM fold f JOIN tries t ON t.dataset_id = f.dataset_id AND t.po_line = f.po_line AND t.nth = f.nth + 1),
covered AS (SELECT dataset_id, po_line, line_number FROM fold WHERE taken),
hits AS (SELECT * FROM keyed k WHERE amount > 10000 AND NOT {o_director('approver_role')}
         AND NOT EXISTS (SELECT 1 FROM covered c WHERE c.dataset_id = k.dataset_id AND c.line_number = k.line_number))"""


check("chk_1_3", approvals.not_a_director, ["approvals"], L)
register("chk_1_3_lines", over_views(lambda a: approvals.not_a_director(a, L).links, ["approvals"]), with_views(["approvals"], _COVERED + f"""
      SELECT {o_link('1.3', 'approvals.csv', 'c.po_line', 'c.line_number').replace('dataset_id,', 'c.dataset_id,', 1)}
      FROM covered c JOIN hits h ON h.dataset_id = c.dataset_id AND h.line_number = c.po_line AND upper(trim(h.type)) = 'PO'"""))
ORACLES["chk_1_3"] = with_views(["approvals"], _COVERED + f"""
      SELECT {o_finding('1.3', 'Medium', 'amount', f"{_LABEL} || ' for $' || {o_fmt('amount')} || ' approved by a ' || CASE WHEN approver_role <> '' THEN approver_role ELSE 'non-director' END || ', not a director'", 'approvals.csv')} FROM hits""")

_UNDER = f"""
WITH near AS (SELECT *, {o_person('requested_by')} AS person, {o_norm('vendor')} AS vendor_key FROM approvals
              WHERE {_INV} AND amount BETWEEN 9600 AND 10000 AND NOT {o_director('approver_role')}),
who AS (SELECT dataset_id, person, count(*) AS n, sum(amount) AS total, max(line_number) AS last_line, arg_max(requested_by, line_number) AS shown
        FROM near WHERE person <> '' GROUP BY dataset_id, person HAVING count(*) >= 2 AND count(DISTINCT vendor_key) >= 2)"""
check("chk_1_6", approvals.just_under_limit, ["approvals"], L, _UNDER + f"""
      SELECT {o_finding('1.6', 'Low', 'total', "trim(shown) || ' raised ' || CAST(n AS VARCHAR) || ' approvals just under the $10,000 director limit'", 'approvals.csv', 'last_line')} FROM who""",
      _UNDER + f""" SELECT {o_link('1.6', 'approvals.csv', 'w.last_line', 'x.line_number').replace('dataset_id,', 'w.dataset_id,', 1)}
      FROM who w JOIN near x ON x.dataset_id = w.dataset_id AND x.person = w.person AND x.line_number <> w.last_line""")

_PEOPLE = f"""
WITH todo AS (SELECT dataset_id, line_number, {o_norm('vendor')} AS vendor_key, {o_person('requested_by')} AS form, {o_parts('requested_by')} AS parts, date, amount, vendor FROM approvals
              WHERE {_INV} AND NOT ({_HAS_PO}) AND amount <= 10000 AND NOT {o_exempt('vendor')}),
forms AS (SELECT dataset_id, vendor_key, form, min(line_number) AS first_line, arg_min(parts, line_number) AS parts FROM todo GROUP BY ALL),
full_form AS (SELECT *, first_value(form) OVER (PARTITION BY dataset_id, vendor_key, parts[1], parts[-1] ORDER BY first_line) AS person
         FROM forms WHERE len(parts) >= 2 AND len(parts[1]) > 1),
short AS (SELECT * FROM forms WHERE NOT (len(parts) >= 2 AND len(parts[1]) > 1)),
fits AS (SELECT s.dataset_id, s.vendor_key, s.form, s.first_line, s.parts, min(f.person) AS p1, count(DISTINCT f.person) AS n
         FROM short s LEFT JOIN full_form f ON f.dataset_id = s.dataset_id AND f.vendor_key = s.vendor_key AND {o_same('f.parts', 's.parts')} GROUP BY ALL),
loose AS (SELECT *, first_value(form) OVER (PARTITION BY dataset_id, vendor_key, parts[1], parts[-1] ORDER BY first_line) AS person FROM fits WHERE n = 0),
people AS (SELECT dataset_id, vendor_key, form, person FROM full_form
UNION ALL SELECT dataset_id, vendor_key, form, CASE WHEN n = 1 THEN p1 ELSE form END FROM fits WHERE n > 0
UNION ALL SELECT dataset_id, vendor_key, form, person FROM loose)"""
register("res_person", over_views(lambda a: approvals.resolve_people(approvals.split_candidates(a, L)), ["approvals"]), with_views(["approvals"], _PEOPLE + " SELECT * FROM people"))

# the greedy walks are folds over numbered rows: a recursive step per row
_SPLIT = _PEOPLE + """,
who AS (SELECT t.*, p.person, row_number() OVER g AS pos, sum(amount) OVER g AS upto FROM todo t JOIN people p ON p.dataset_id = t.dataset_id AND p.vendor_key = t.vendor_key AND p.form = t.form
        WINDOW g AS (PARTITION BY t.dataset_id, t.vendor_key, p.person ORDER BY t.date, t.line_number)),
win AS (SELECT a.dataset_id, a.vendor_key, a.person, a.pos, a.line_number, a.vendor, max(b.pos) AS stop, sum(b.amount) AS total, count(*) AS n FROM who a
        JOIN who b ON b.dataset_id = a.dataset_id AND b.vendor_key = a.vendor_key AND b.person = a.person AND b.pos >= a.pos AND b.date <= a.date + 3 GROUP BY ALL),
walk(dataset_id, vendor_key, person, pos, free_from, hit) AS (
  SELECT dataset_id, vendor_key, person, pos, CASE WHEN n >= 2 AND total > 10000 THEN stop + 1 ELSE 0 END, n >= 2 AND total > 10000 FROM win WHERE pos = 1
  UNION ALL SELECT w.dataset_id, w.vendor_key, w.person, w.pos, CASE WHEN w.pos >= k.free_from AND n >= 2 AND total > 10000 THEN stop + 1 ELSE k.free_from END,
    w.pos >= k.free_from AND n >= 2 AND total > 10000 FROM walk k JOIN win w ON w.dataset_id = k.dataset_id AND w.vendor_key = k.vendor_key AND w.person = k.person AND w.pos = k.pos + 1),
picked AS (SELECT w.*, m.line_number AS m_line, m.vendor AS m_vendor FROM walk k JOIN win w ON w.dataset_id = k.dataset_id AND w.vendor_key = k.vendor_key AND w.person = k.person AND w.pos = k.pos
           JOIN who m ON m.dataset_id = w.dataset_id AND m.vendor_key = w.vendor_key AND m.person = w.person AND m.pos BETWEEN w.pos AND w.stop WHERE k.hit),
split AS (SELECT dataset_id, vendor_key, person, pos, n, total, max(m_line) AS last_line, arg_max(m_vendor, m_line) AS shown FROM picked GROUP BY ALL)"""


check("chk_1_4", approvals.split_orders, ["approvals"], L, lines_sql="")
_SPLIT_TITLE = f"CAST(n AS VARCHAR) || ' ' || shown || ' invoices without a PO within 3 days, total $' || {o_fmt('total')} || ' - possible split to avoid director approval'"
ORACLES["chk_1_4"] = with_views(["approvals"], _SPLIT + f" SELECT {o_finding('1.4', 'Medium', 'total', _SPLIT_TITLE, 'approvals.csv', 'last_line')} FROM split")
ORACLES["chk_1_4_lines"] = with_views(["approvals"], _SPLIT + f""" SELECT {o_link('1.4', 'approvals.csv', 's.last_line', 'p.m_line').replace('dataset_id,', 's.dataset_id,', 1)}
    FROM split s JOIN picked p ON p.dataset_id = s.dataset_id AND p.vendor_key = s.vendor_key AND p.person = s.person AND p.pos = s.pos AND p.m_line <> s.last_line""")

# ---------------------------------------------------------------- vendors
_PAID = "trim(last_paid_on) <> ''"
_ACTIVE = "(trim(status) = '' OR starts_with(upper(trim(status)), 'ACTIVE'))"
_PAID_TEXT = f"CASE WHEN last_paid_amount <> 0 THEN '$' || {o_fmt('last_paid_amount')} || ' ' ELSE '' END"
check("chk_4_3", vendors.bank_changed, ["vendors"], L, f"""
      WITH c AS (SELECT *, {_PAID} AND NOT coalesce(last_paid_date < bank_changed_date, false) AS lost FROM vendors
                 WHERE trim(bank_changed_on) <> '' AND upper(trim(bank_verified)) NOT IN ({o_list(S.YES)}) AND trim(bank_changed_on) <> trim(created_on))
      SELECT {o_finding('4.3', "CASE WHEN lost THEN 'High' ELSE 'Medium' END", 'CASE WHEN lost THEN last_paid_amount ELSE 0 END', "vendor_id || CASE WHEN lost THEN ' paid to an unverified new bank account' ELSE ' changed bank account on ' || trim(bank_changed_on) || ' with no verification; the next payment would go to it' END", 'vendors.csv')} FROM c""")
check("chk_4_1_vendor", vendors.inactive_paid, ["vendors"], L, f"""
      SELECT {o_finding('4.1', 'Medium', 'last_paid_amount', f"upper(status[1]) || lower(substr(status, 2)) || ' vendor ' || vendor_id || ' was paid ' || {_PAID_TEXT} || 'on ' || last_paid_on", 'vendors.csv')}
      FROM vendors WHERE NOT {_ACTIVE} AND {_PAID} AND NOT coalesce(last_paid_date <= status_changed_date, false)""")
check("chk_4_4", vendors.no_tax_form, ["vendors"], L, f"""
      WITH u AS (SELECT *, bool_or(trim(w9_on_file) <> '') OVER (PARTITION BY dataset_id) AS used FROM vendors)
      SELECT {o_finding('4.4', 'Low', 'last_paid_amount', f"vendor_id || ' paid ' || {_PAID_TEXT} || 'with no tax form on file'", 'vendors.csv')}
      FROM u WHERE {_PAID} AND (upper(trim(w9_on_file)) IN ({o_list(S.NO)}) OR (trim(w9_on_file) = '' AND used))""")
register("agg_migrated", over_views(lambda v: vendors.import_dates(v).select("dataset_id", "created_date", "n", "vendors"), ["vendors"]),
         with_views(["vendors"], """SELECT dataset_id, created_date, n, vendors FROM
           (SELECT dataset_id, created_date, count(*) AS n FROM vendors GROUP BY dataset_id, created_date)
           JOIN (SELECT dataset_id, count(*) AS vendors FROM vendors GROUP BY dataset_id) USING (dataset_id)
           WHERE n >= 5 AND n >= 0.3 * vendors"""))
check("chk_4_5", vendors.new_vendor_paid, ["vendors"], L, f"""
      WITH moved AS (SELECT dataset_id, created_date FROM (SELECT dataset_id, created_date, count(*) AS n FROM vendors GROUP BY dataset_id, created_date)
                     JOIN (SELECT dataset_id, count(*) AS t FROM vendors GROUP BY dataset_id) USING (dataset_id) WHERE n >= 5 AND n >= 0.3 * t)
      SELECT {o_finding('4.5', 'Medium', 'last_paid_amount', f"vendor_id || ' was paid $' || {o_fmt('last_paid_amount')} || ' ' || CAST(last_paid_date - created_date AS VARCHAR) || ' days after it was set up'", 'vendors.csv')}
      FROM vendors v WHERE last_paid_date - created_date BETWEEN 0 AND 30 AND last_paid_amount > 10000 AND {_ACTIVE}
        AND NOT EXISTS (SELECT 1 FROM moved m WHERE m.dataset_id = v.dataset_id AND m.created_date = v.created_date)""")
_TAX = f"""
WITH t AS (SELECT *, regexp_replace(lower(tax_id), '[^0-9a-z]', '', 'g') AS tax FROM vendors WHERE NOT regexp_matches(name, '{screens.REMIT_TO}')),
shared AS (SELECT *, min(line_number) OVER g AS first_line, arg_min(vendor_id, line_number) OVER g AS other, arg_min(last_paid_amount, line_number) OVER g AS other_paid
           FROM t WHERE len(tax) >= 4 AND tax NOT IN ({o_list(S.PLACEHOLDER_TAX_IDS)}) AND NOT regexp_full_match(tax, '0+') WINDOW g AS (PARTITION BY dataset_id, tax))"""
check("chk_4_2", vendors.shared_tax_id, ["vendors"], L, _TAX + f"""
      SELECT {o_finding('4.2', 'High', 'last_paid_amount + other_paid', "'Vendor records ' || other || ' and ' || vendor_id || ' share tax ID ' || trim(tax_id)", 'vendors.csv')}
      FROM shared WHERE line_number > first_line""", _TAX + f" SELECT {o_link('4.2', 'vendors.csv', 'line_number', 'first_line')} FROM shared WHERE line_number > first_line")

# ---------------------------------------------------------------- expenses
_RECEIPT = f"CASE WHEN upper(trim(receipt_ref)) IN ({o_list(S.NO_RECEIPT)}) THEN '' ELSE trim(receipt_ref) END"


def o_screen(x: str, pattern: str) -> str:
    """A screen pattern for RE2, which has no (?U) and no lookaround."""
    plain = pattern.replace("(?iU)", "(?i)").replace("(?! protective)", "").replace("'", "''")
    return f"regexp_matches({x}, '{plain}')"


def o_heads(people: str, notes: str) -> str:
    words = o_list(S.NUMBER_WORDS)
    noted = (f"coalesce(nullif(regexp_extract({notes}, '{screens.HEADCOUNT_IN_NOTES.replace('(?iU)', '(?i)')}', 1), ''), "
             f"regexp_extract({notes}, '{screens.HEADCOUNT_IN_NOTES.replace('(?iU)', '(?i)')}', 3))")

    def count(x: str) -> str:
        t = f"lower(trim({x}))"
        n = f"TRY_CAST({t} AS DOUBLE)"
        return (f"CASE WHEN list_contains([{words}], {t}) THEN list_position([{words}], {t}) "
                f"WHEN {n} = floor({n}) AND {n} > 0 AND {n} <= 200 THEN CAST({n} AS INTEGER) ELSE 0 END")
    return f"CASE WHEN {count(people)} > 0 THEN {count(people)} ELSE {count(noted)} END"


check("chk_6_1", expenses.meals, ["expenses"], L, f"""
      WITH m AS (SELECT *, {o_heads('people', 'notes')} AS heads FROM expenses WHERE upper(trim(category)) IN ({o_list(S.MEAL_CATEGORIES)}))
      SELECT {o_finding('6.1', 'Low', 'amount', f"CASE WHEN heads > 0 THEN 'Meal at $' || {o_fmt('CAST(amount AS DOUBLE) / heads')} || ' per person (limit $75.00)' ELSE 'Meal of $' || {o_fmt('amount')} || ' with no head count recorded (limit $75.00 per person)' END", 'expenses.csv')}
      FROM m WHERE CASE WHEN heads > 0 THEN amount > 75 * heads ELSE amount > 75 END""")
check("chk_6_2", expenses.no_receipt, ["expenses"], L, f"""
      SELECT {o_finding('6.2', 'Medium', 'amount', f"'Claim ' || claim_id || ' of $' || {o_fmt('amount')} || ' has no receipt'", 'expenses.csv')}
      FROM expenses WHERE amount > 25 AND {_RECEIPT} = '' AND NOT {o_screen('category', screens.NO_RECEIPT_KINDS)}""")
check("chk_6_3", expenses.personal_item, ["expenses"], L, f"""
      SELECT {o_finding('6.3', 'Low', 'amount', "'Personal item claimed: ' || lower(trim(notes))", 'expenses.csv')}
      FROM expenses WHERE {o_screen('notes', screens.PERSONAL)} AND NOT {o_screen('notes', screens.PROFESSIONAL)}""")
_AGAIN = f"""
WITH r AS (SELECT *, {_RECEIPT} AS ref FROM expenses), k AS (SELECT *, regexp_replace(upper(ref), '\\s+', '', 'g') AS receipt FROM r WHERE ref <> ''),
f AS (SELECT *, min(line_number) OVER (PARTITION BY dataset_id, receipt) AS first_line FROM k)"""
check("chk_6_5", expenses.receipt_again, ["expenses"], L, _AGAIN + f"""
      SELECT {o_finding('6.5', 'High', 'amount', "'The same receipt ' || ref || ' was claimed twice'", 'expenses.csv')} FROM f WHERE line_number > first_line""",
      _AGAIN + f" SELECT {o_link('6.5', 'expenses.csv', 'line_number', 'first_line')} FROM f WHERE line_number > first_line")
check("chk_6_4", expenses.weekend_claim, ["expenses"], L, f"""
      WITH k AS (SELECT *, {o_person('employee')} AS person FROM expenses),
      trips AS (SELECT * FROM k WHERE ({o_screen('category', screens.TRIP_CATEGORY)} OR {o_screen('notes', screens.TRAVEL)}) AND lower(trim(notes)) <> 'business purpose recorded')
      SELECT {o_finding('6.4', 'Low', 'amount', "'Weekend expense ' || claim_id || ' with no reason given'", 'expenses.csv')}
      FROM k WHERE isodow(date) >= 6 AND trim(notes) = '' AND NOT ({o_screen('category', screens.TRAVEL_SPEND)} AND EXISTS (
        SELECT 1 FROM trips t WHERE t.dataset_id = k.dataset_id AND t.person = k.person AND t.line_number <> k.line_number AND t.date BETWEEN k.date - 1 AND k.date + 1))""")
check("chk_6_6", expenses.under_receipt_limit, ["expenses"], L, lines_sql="")
_UNDER_RECEIPT = f"""
WITH near AS (SELECT *, {o_person('employee')} AS person FROM expenses WHERE amount BETWEEN 22.5 AND 25 AND {_RECEIPT} = '' AND NOT {o_screen("category || ' ' || notes", screens.NO_RECEIPT_KINDS)}),
n AS (SELECT *, row_number() OVER g AS pos, coalesce(date - lag(date, 2) OVER g <= 30, false) AS near3 FROM near WHERE person <> '' WINDOW g AS (PARTITION BY dataset_id, person ORDER BY date, line_number)),
walk(dataset_id, person, pos, last_hit, hit) AS (SELECT dataset_id, person, pos, CAST(-5 AS BIGINT), false FROM n WHERE pos = 1
  UNION ALL SELECT n.dataset_id, n.person, n.pos, CASE WHEN near3 AND n.pos >= last_hit + 3 THEN n.pos ELSE last_hit END, near3 AND n.pos >= last_hit + 3
  FROM walk w JOIN n ON n.dataset_id = w.dataset_id AND n.person = w.person AND n.pos = w.pos + 1),
three AS (SELECT w.dataset_id, w.person, w.pos, m.line_number, m.amount, m.employee FROM walk w JOIN n m ON m.dataset_id = w.dataset_id AND m.person = w.person AND m.pos BETWEEN w.pos - 2 AND w.pos WHERE hit),
run3 AS (SELECT dataset_id, person, pos, sum(amount) AS total, max(line_number) AS last_line, arg_max(employee, line_number) AS shown FROM three GROUP BY ALL)"""
_RUN_TITLE = "trim(shown) || ' made 3 claims without a receipt just under the $25.00 receipt limit within 30 days'"
ORACLES["chk_6_6"] = with_views(["expenses"], _UNDER_RECEIPT + f" SELECT {o_finding('6.6', 'Low', 'total', _RUN_TITLE, 'expenses.csv', 'last_line')} FROM run3")
ORACLES["chk_6_6_lines"] = with_views(["expenses"], _UNDER_RECEIPT + f""" SELECT {o_link('6.6', 'expenses.csv', 'r.last_line', 't.line_number').replace('dataset_id,', 'r.dataset_id,', 1)}
    FROM run3 r JOIN three t ON t.dataset_id = r.dataset_id AND t.person = r.person AND t.pos = r.pos AND t.line_number <> r.last_line""")
