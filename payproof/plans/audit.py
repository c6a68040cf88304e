"""The whole audit of many datasets at once."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.operators import approvals, documents, expenses, gate, payments, reconcile, vendors
from payproof.operators.findings import Found, all_of
from payproof.scale import checkpointed
from payproof.sources import headers, reports, tables


@dataclass
class Files:
    """Typed tables of the kinds at hand; None for a kind nobody sent."""
    payments: DataFrame | None = None
    approvals: DataFrame | None = None
    vendors: DataFrame | None = None
    expenses: DataFrame | None = None
    bank: DataFrame | None = None
    payment_run: DataFrame | None = None
    contracts: DataFrame | None = None
    invoices: DataFrame | None = None


# --- which checks run over one kind of file; the rest of run_area needs two kinds ---
OF_PAYMENTS = [payments.paid_twice, payments.overpaid, payments.no_reference, payments.paid_early, payments.weekend_release, payments.near_duplicates]
OF_APPROVALS = [approvals.self_approved, approvals.no_purchase_order, approvals.not_a_director, approvals.split_orders, approvals.late_order,
                approvals.just_under_limit]
OF_VENDORS = [vendors.bank_changed, vendors.inactive_paid, vendors.no_tax_form, vendors.new_vendor_paid, vendors.shared_tax_id]
OF_CONTRACTS = [documents.excluded_charge, documents.rate_above_contract, documents.silent_renewal, documents.after_contract_end]
OF_EXPENSES = [expenses.meals, expenses.no_receipt, expenses.personal_item, expenses.receipt_again, expenses.weekend_claim, expenses.under_receipt_limit]


def run_area(area: str, f: Files, limits: dict | None = None) -> list[Found]:
    """The checks of one area, as far as its files are there; partners and candidates are bounded only where `limits` says so."""
    L = S.limits_with(S.WHOLE | (limits or {}))
    found: list[Found] = []
    if area == "Payments" and f.payments is not None:
        found += [check(f.payments, L) for check in OF_PAYMENTS]
        if f.vendors is not None:
            found += [payments.vendor_status_at_payment(f.payments, f.vendors, L), payments.unknown_payee(f.payments, f.vendors, L)]
        if f.bank is not None:
            r = reconcile.reconcile(f.bank, f.payments, L)
            found += [reconcile.bank_without_record(r), reconcile.payment_not_on_statement(r, L)]
    if area == "Approvals" and f.approvals is not None:
        found += [check(f.approvals, L) for check in OF_APPROVALS]
    if area == "Vendors" and f.vendors is not None:
        found += [check(f.vendors, L) for check in OF_VENDORS]
    if area == "Contracts" and f.contracts is not None:
        found += [check(f.contracts, L) for check in OF_CONTRACTS]
    if area == "Expenses" and f.expenses is not None:
        found += [check(f.expenses, L) for check in OF_EXPENSES]
    if area == "Invoices" and f.invoices is not None and f.vendors is not None:
        found += [documents.submitted_again(f.invoices, f.vendors, L), documents.other_account(f.invoices, f.vendors, L)]
        if f.approvals is not None:
            found.append(documents.not_approved(f.invoices, f.vendors, f.approvals, L))
    return found


def analyze(f: Files, limits: dict | None = None) -> Found:
    """Every check over every dataset: one flat union of findings, and one of the lines that support them."""
    return all_of([found for area in S.AREAS for found in run_area(area, f, limits)])


def hold_or_release(f: Files) -> DataFrame | None:
    """The payment gate's decision on every line of the payment runs; None without one. A kind that nobody sent is empty,
    and the reasons say what could not be compared."""
    if f.payment_run is None:
        return None
    spark = f.payment_run.sparkSession
    others = [t if t is not None else tables.empty(spark, kind) for t, kind in ((f.vendors, "vendors.csv"), (f.approvals, "approvals.csv"), (f.payments, "payments.csv"))]
    return gate.evaluate(f.payment_run, *others)


def files_from_lines(lines: DataFrame, kinds: list[str]) -> tuple[Files, DataFrame | None]:
    """(typed tables, header report) from numbered raw lines whose source_file is the kind. Headers are matched without
    a person; a file that lacks a column nobody can suggest is not checked, and the report says so."""
    typed: dict[str, DataFrame] = {kind: lines.where(F.col("source_file") == kind) for kind in kinds if kind.endswith(".txt")}
    listed = [kind for kind in kinds if kind not in typed]
    report = None
    if listed:
        # all kinds in one pass, as every step works file by file; each is read several times by the next
        joined = checkpointed(reports.join_broken(lines.where(F.col("source_file").isin(listed))))
        plain = checkpointed(reports.tidied(checkpointed(reports.to_commas(joined))))
        report = checkpointed(headers.auto_matched(headers.headers(plain)))         # a row per file, read by every check
        for kind in listed:
            mine = F.col("source_file") == kind
            typed[kind] = tables.typed(plain.where(mine), report.where(mine & F.col("checked")), kind)
    files = Files(payments=typed.get("payments.csv"), approvals=typed.get("approvals.csv"), vendors=typed.get("vendors.csv"),
                  expenses=typed.get("expenses.csv"), bank=typed.get("bank_statement.csv"), payment_run=typed.get("payment_run.csv"),
                  contracts=typed.get("contracts.txt"), invoices=typed.get("invoices.txt"))
    return files, report
