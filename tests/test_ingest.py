import pytest

from payproof.plans.audit import files_from_lines
from payproof.sources import headers, lines, reports, tables, textfiles
from payproof.streaming import folder

LINE = "dataset_id string, source_file string, line_number long, text string"


def file(spark, rows, name="payments.csv"):
    return spark.createDataFrame([("A", name, i, t) for i, t in enumerate(rows, 1)], LINE).repartition(3)


def texts(df):
    return [r["text"] for r in df.orderBy("line_number").collect()]


@pytest.mark.parametrize("raw, want", [
    ("a,é\n".encode(), "a,é\n"), (b"\xef\xbb\xbfa", "a"), ("é,b".encode("cp1252"), "é,b"), ("支払,山田".encode("cp932"), "支払,山田"), ("Hélène,x".encode("cp1252"), "Hélène,x"),
    ("amount,name".encode("utf-16"), "amount,name"), ("amount,name".encode("utf-16-le"), "amount,name"), ("amount,name".encode("utf-16-be"), "amount,name")])
def test_decoding(raw, want):
    assert lines.decode_bytes(raw) == want


def test_broken_values_are_joined_only_when_they_fit(spark):
    rows = ["id,notes,amount", '1,"two', 'lines",5', '2,5" pipe,6', '3,plain,7', '4,"never closed,8', "5,x,9"]
    assert texts(reports.join_broken(file(spark, rows))) == ["id,notes,amount", '1,"two lines",5', '2,5" pipe,6', '3,plain,7', '4,"never closed,8', "5,x,9"]


def test_numbered_text_over_many_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"line {i}" for i in range(1, 5001)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    got = lines.numbered_text(spark, str(tmp_path)).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5000 and all(r["text"] == f"line {r['line_number']}" for r in got)


def test_values_broken_in_any_dialect(spark):
    for sep in (",", ";", "\t"):
        x = reports.to_commas(reports.join_broken(file(spark, [f"a{sep}b{sep}c", f'1{sep}"North', f'South"{sep}30', f"2{sep}West{sep}40"])))
        assert [(r["line_number"], r["text"]) for r in x.orderBy("line_number").collect()][1:] == [(2, "1,North South,30" if sep != "," else '1,"North South",30'), (4, "2,West,40")]


def many(spark, files):
    return spark.createDataFrame([(f"D{d}", "payments.csv", i, t) for d, rows in enumerate(files) for i, t in enumerate(rows, 1)], LINE).repartition(3)


def test_values_over_many_breaks(spark):
    files, want = [], []
    for breaks in (2, 5, 6, 20):
        for sep in (",", ";", "\t"):
            middle = [f"part {i}" for i in range(1, breaks)]
            files.append([sep.join("abc"), f'1{sep}"one', *middle, f'last"{sep}5', sep.join("2xy")])
            want.append([sep.join("abc"), f'1{sep}"' + " ".join(["one", *middle, "last"]) + f'"{sep}5', sep.join("2xy")])
    far = [f"{i},x,y" for i in range(2, 9)]
    # within five breaks a line may read like a row; beyond them a stray quote is likelier; the next line never is a row of its own
    files += [["a,b,c", '1,"two', "more", "2,x,y", 'last",5'], ["a,b,c", '1,"two', "more", *far, 'last",5'], ["a,b,c", '1,"two', "2,x,y", 'last",5']]
    want += [["a,b,c", '1,"two more 2,x,y last",5'], files[-2], files[-1]]
    got = reports.join_broken(many(spark, files)).collect()
    assert [[r["text"] for r in sorted(got, key=lambda r: r["line_number"]) if r["dataset_id"] == f"D{d}"] for d in range(len(files))] == want


HEAD, DATA = "Date,Num,Memo,Open Balance,Amount", "2026-09-01,17,ok,30.00,5.00"
HEADERS = [
    ([HEAD, DATA], 1), (["Acme Ltd", "Bill Payment List", "From,09/01/2026,To,09/30/2026", HEAD, DATA], 4),
    ([*[f"Note {i}" for i in range(40)], HEAD, DATA, DATA], 41),             # forty lines of words come first
    ([*["" for _ in range(30)], "From,09/01/2026,To,09/30/2026", HEAD, DATA], 32),
    ([*[f"Note {i}" for i in range(40)], "Acme,North,Leeds", HEAD, DATA], 42),    # the widest before the data
    (["Acme", "Date,Num,Memo", "Date,Num,Memo,More", DATA, "Date,Num,Memo,More,Most,Rest"], 3),
    (["Acme", DATA, HEAD, DATA], 1),                                        # the data has begun
    (["Acme", "a,b,1", HEAD, DATA], 1),                                     # an unfamiliar layout
    (["Acme", "Date,Date,Memo", DATA], 1), ([DATA, DATA], 1), (["Acme"], 1), ([""], 1),
    ([HEAD, "", HEAD + ",More", DATA], 3)]


def test_where_the_column_names_stand(spark):
    got = {r["dataset_id"]: r["header_line"] for r in reports.header_lines(many(spark, [rows for rows, _ in HEADERS])).collect()}
    assert [got[f"D{d}"] for d in range(len(HEADERS))] == [at for _, at in HEADERS]


def test_decimal_commas_and_date_order(spark):
    rows = ["payment_id;pay_date;invoice_date;supplier;invoice_no;invoice_amount;paid_amount", "P1;13/09/2026;01/09/2026;Ashby;I1;1.234;99,00", "P2;02/09/2026;01/09/2026;Ashby;I2;;1.000,50"]
    x = reports.to_commas(file(spark, rows))
    got = tables.typed(x, headers.headers(x), "payments.csv").orderBy("line_number").collect()
    assert [str(r["pay_date"]) for r in got] == ["2026-09-13", "2026-09-02"]
    assert [float(r["paid_amount"]) for r in got] == [99.0, 1000.5] and [r["invoice_amount_blank"] for r in got] == [False, True]


def test_recognition_reasons(spark):
    pay = ["Payment No", "Date Paid", "Bill Date", "Vendor", "Bill No", "Bill Amount", "Amount Paid"]
    files = [("A", "export.csv", pay, []), ("B", "export.csv", pay, ["payments.csv"]), ("C", "Chase.csv", ["Date", "Description", "Amount", "Balance"], []), ("D", "list.csv", ["Date", "Description", "Amount"], []),
             ("E", "notes.csv", [], [])]
    got = {r.dataset_id: r for r in headers.recognised(spark.createDataFrame(files, "dataset_id string, source_file string, header array<string>, taken array<string>")).collect()}
    assert (got["A"].kind, got["A"].share, got["A"].why_not) == ("payments.csv", 1.0, "") and got["C"].kind == "bank_statement.csv"
    assert got["B"].kind is None and got["D"].kind is None and got["E"].why_not == "its columns do not look like any of the audit files"


def test_header_cells_are_never_broadcast(spark):
    files = spark.createDataFrame([("A", "a.csv", ["Date", "Amount"], ["amount"])], "dataset_id string, source_file string, header array<string>, missing array<string>")
    assert "SortMergeJoin" in headers._assigned(files, headers.FILE)._jdf.queryExecution().executedPlan().toString()


def test_headings_meet_no_lines_without_a_group(spark):
    rows = ["Acme", ",Date,Num,Amount", "Ashby", ",2026-09-01,I1,10.00", "Total Ashby,,,10.00", "5", ",2026-09-02,I2,4.00", "7,2026-09-02,I3,5.00", "Total 5,,,4.00"]
    got = {r["line_number"]: (r["kind"], r["under"]) for r in reports.classified(file(spark, rows)).collect()}
    assert got[4] == ("row", "Ashby") and got[5][0] == "total" and got[7] == ("row", "5") and got[8][0] == "row" and got[9][0] == "total"


def test_folder_job_reports_new_findings_once(spark, tmp_path):
    src, out, alerts = tmp_path / "in", str(tmp_path / "out"), []
    (src / "acme").mkdir(parents=True)
    head = "claim_id,date,employee,category,amount,receipt_ref,notes,people\n"
    (src / "acme" / "expenses.csv").write_text(head + "C1,2026-09-01,Kate Lowe,Parking,90.00,,,\nC2,2026-09-02,Kate Lowe,Parking,20.00,R1,,\n")

    def alert(feed):
        alerts.append({r["dataset_id"]: r["new_findings"] for r in feed.collect()})
    folder.watch(spark, str(src), out, ["expenses.csv"], alert).awaitTermination()
    assert alerts == [{"acme": 1}]
    (src / "acme" / "expenses_late.csv").write_text("not,an,audit\n")          # touches the dataset; the slot is taken
    folder.watch(spark, str(src), out, ["expenses.csv"], alert).awaitTermination()
    assert alerts[1] == {"acme": 0}                                           # nothing new, but a file that was not read
    assert [r["note"] for r in spark.read.parquet(out + "/problems/batch=1").collect()] == ["Two files are read as expenses.csv: kept expenses.csv, skipped expenses_late.csv"]
    (src / "beta").mkdir()
    (src / "beta" / "expenses.csv").write_text(head + "C9,2026-09-01,Raj Patel,Parking,60.00,,gym,\n")

    def failing(feed):
        raise OSError("no network")
    with pytest.raises(Exception):
        folder.watch(spark, str(src), out, ["expenses.csv"], failing).awaitTermination()
    folder.watch(spark, str(src), out, ["expenses.csv"], alert).awaitTermination()
    assert alerts[2] == {"beta": 2}                                           # a failed alert is tried again


EXPENSES = "claim_id,date,employee,category,amount,receipt_ref,notes,people"
NO_RECEIPT = "C1,2026-09-01,Kate Lowe,Parking,90.00,,,"


def put(at, *rows):
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text("".join(r + "\n" for r in rows))


def check_folder(spark, src, out, areas=("Expenses", "Vendors")):
    feeds = []
    kinds = ["expenses.csv", "vendors.csv", "approvals.csv", "payments.csv", "payment_run.csv"]
    folder.watch(spark, str(src), out, kinds, lambda feed: feeds.extend(feed.collect()), list(areas)).awaitTermination()
    return {r["dataset_id"]: r for r in feeds}


def test_folder_job_holds_payments_and_reports_what_it_could_not_check(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    put(src / "acme" / "payment_run.csv", "line,vendor_id,supplier,invoice,amount,bank_last4", "1,V-1,Ashby,I-1,50.00,", "2,V-9,=Nobody,I-2,60.00,")
    put(src / "acme" / "vendors.csv", "vendor_id,name,tax_id,status,bank_changed_on,bank_verified,w9_on_file,last_paid_on,last_paid_amount", "V-1,Ashby,T1,ACTIVE,,,Y,,0")
    put(src / "beta" / "payment_run.csv", "a,b,c", "1,2,3")
    put(src / "gamma" / "notes.md", "nothing to check")
    # one file that was saved in parts: its lines are numbered through
    put(src / "dataset=delta" / "kind=expenses.csv" / "part-00000", EXPENSES, "C0,2026-09-01,Kate Lowe,Parking,9.00,R1,,")
    put(src / "dataset=delta" / "kind=expenses.csv" / "part-00001", NO_RECEIPT, "C2,2026-09-02,Kate Lowe,Parking,9.00,R2,gym,")
    got = check_folder(spark, src, out)
    assert {k: (r["new_findings"], r["held"], r["problems"]) for k, r in got.items()} == {"acme": (0, 1, 0), "beta": (0, 0, 2), "gamma": (0, 0, 1), "delta": (2, 0, 0)}
    holds = spark.read.option("header", True).csv(out + "/holds").collect()
    assert [(r["dataset_id"], r["line"], r["supplier"], r["amount"]) for r in holds] == [("acme", "2", "'=Nobody", "60.00")] and "not checked: no approvals.csv, payments.csv" in holds[0]["reason"]
    assert sorted((r["clause"], r["line_number"]) for r in spark.read.option("header", True).csv(out + "/findings").collect()) == [("6.2", "3"), ("6.3", "4")]
    assert sorted((r["dataset_id"], r["nth"], r["line"][:40]) for r in spark.read.parquet(out + "/alert_lines").where("line LIKE 'NOT%'").collect()) == [
        ("beta", 11, "NOT CHECKED: payment_run.csv is missing "), ("beta", 12, "NOT CHECKED: payment_run.csv could not b"), ("gamma", 11, "NOT CHECKED: No audit files were found i")]


def test_state_is_the_last_report_of_each_dataset(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    for name in ("acme", "beta"):
        put(src / name / "expenses.csv", EXPENSES, NO_RECEIPT)
    assert {k: r["new_findings"] for k, r in check_folder(spark, src, out).items()} == {"acme": 1, "beta": 1}
    put(src / "acme" / "expenses.csv", EXPENSES, NO_RECEIPT.replace("90.00", "9.00"))          # the finding goes
    put(src / "acme" / "read.me", "")
    assert check_folder(spark, src, out) == {}
    put(src / "acme" / "expenses.csv", EXPENSES, NO_RECEIPT)                                   # and comes again
    put(src / "acme" / "read2.me", "")
    assert {k: r["new_findings"] for k, r in check_folder(spark, src, out).items()} == {"acme": 1}
    put(src / "beta" / "read.me", "")                                                          # another dataset's state stayed
    assert check_folder(spark, src, out) == {}


def test_files_nobody_can_match_are_reported(spark):
    _, report = files_from_lines(file(spark, ["a,b,c", "1,2,3"]), ["payments.csv"])
    assert folder.data_problems(report).count() == 1


def invoices(spark, *documents):
    rows = [("A", "invoices.txt", i, t) for i, t in enumerate((t for d in documents for t in d), 1)]
    return textfiles.invoice_blocks(spark.createDataFrame(rows, LINE).repartition(4)).orderBy("start").collect()


def test_invoices_inside_one_document(spark):
    got = invoices(spark, ["[PDF a.pdf]", "Birch Ltd", "Invoice No: A-1", "Invoice No: A-2", "Total 5.00", "Invoice No: A-1", "Amount due: 6.00", "Total 7.00", "Invoice No: A-3", "From: Ashby", "Total 9.00"],
                   ["[PDF b #1.pdf]", "Total 1.00", "Invoice No: B-1", "Invoice No: B-2"], ["[PDF c.pdf]"],
                   ["[PDF d.pdf]", "From: Cedar", "Account no 11111", "Pay to bank account 22222", "Pay to bank account 33333", "Invoice No: D-1", "Total 2.00", "Invoice No: D-1", "Invoice No: D-2"])
    # another number before a total isn't another invoice, the first one's own number after it neither
    assert [(r["name"], r["start"], r["number"], r["total"], r["bank"], r["vendor"], r["guess"]) for r in got] == [
        ("a.pdf", 1, "A-1", "6.00", None, None, "Birch Ltd"), ("a.pdf #2", 8, "A-3", "9.00", None, "Ashby", "Birch Ltd"),
        ("b #1.pdf", 12, "B-1", "1.00", None, None, "Total 1.00"), ("b #2", 14, "B-2", None, None, None, "Total 1.00"),
        ("c.pdf", 16, None, None, None, None, None),
        ("d.pdf", 17, "D-1", "2.00", "22222", "Cedar", None), ("d.pdf #2", 24, "D-2", None, None, "Cedar", None)]
    assert [(r["number_line"], r["total_line"], r["vendor_line"], r["guess_line"]) for r in got[:2]] == [(3, 7, None, 2), (9, 11, 10, 2)]


def test_a_document_of_many_invoices(spark):
    pages = [t for i in range(3000) for t in (f"Invoice No: N-{i}", "some words", f"Total {i}.00", f"Invoice No: N-{i}")]
    got = invoices(spark, ["[PDF all.pdf]", "From: Ashby", *pages], ["[PDF one.pdf]", "Invoice No: X-1"])
    assert len(got) == 3001 and {r["vendor"] for r in got[:-1]} == {"Ashby"} and got[2999]["name"] == "all.pdf #3000"
    assert all((r["number"], r["total"], r["number_line"]) == (f"N-{i}", f"{i}.00", 4 * i + 3) for i, r in enumerate(got[:-1]))


def test_no_invoices(spark):
    assert invoices(spark, ["no document", "Invoice No: A-1", "Total 5.00"]) == []
