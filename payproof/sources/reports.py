"""Report-style and broken exports: separators, values broken over lines, title and total lines, group headings,
line items."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof.functions import csvtext, text
from payproof.scale import checkpointed, facts, line_block, running
from payproof.sources.headers import FILE
from payproof.sources.textfiles import latest

# --- fixed values: what numbers, dates, totals and line-item columns look like -
NUMERIC = r"(?i)^[$€£(+-]{0,3}\d[\d,.']*(?: [\d,.']+)*\)?(?: ?(?:CR|DR))?$"
DATE_START = r"^\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}"
TOTAL = r"(?i)^(?:grand\s)?\s*totals?(?:\s+for\b.*|:)?$"
NAME_COLUMNS = ["vendor", "supplier", "payee", "name", "vendor name", "supplier name", "payee name", "contact",
                "contact name", "merchant", "employee"]
LINE_ITEM = (r"\b(description|quantity|qty|unit (?:amount|price|cost)|line (?:amount|total|description)|item|account code|"
             r"tax (?:type|amount)|tracking|discount)\b")
QUANTITY = r"\b(quantity|qty|unit (?:amount|price|cost)|line (?:amount|total))\b"
NEAR_BREAKS = 5
HEADER_SEARCH = 25


# ---------------------------------------------------------------- separators
def separators(lines: DataFrame) -> DataFrame:
    """Per file: comma, tab or semicolon, from its first line and its name."""
    first = lines.groupBy(*FILE).agg(F.min_by("text", "line_number").alias("top"))
    comma = F.contains("top", F.lit(","))
    semis = F.length("top") - F.length(F.replace(F.col("top"), F.lit(";"), F.lit("")))
    sep = (F.when(F.lower("source_file").endswith(".tsv") | (F.contains("top", F.lit("\t")) & ~comma), "\t")
           .when((semis >= 2) & ~comma, ";").otherwise(","))
    return first.select(*FILE, sep.alias("sep"))


def _cells(line: Column, sep: Column) -> Column:
    """Cells of a line in its file's own separator."""
    return F.when(sep == "\t", csvtext.cells(line, "\t")).when(sep == ";", csvtext.cells(line, ";")).otherwise(csvtext.cells(line))


def to_commas(lines: DataFrame) -> DataFrame:
    """Tab and semicolon files as comma-separated lines. Values broken over lines are joined before, while their quotes are
    those of the file."""
    x = lines.join(facts(separators(lines)), FILE)
    stray = csvtext.quote_count(F.col("text")) % 2 == 1

    def rewritten(sep: str) -> Column:
        return csvtext.to_line(F.when(stray, csvtext.bare_cells(F.col("text"), sep)).otherwise(csvtext.cells(F.col("text"), sep)))
    return x.withColumn("text", F.when(F.col("sep") == "\t", rewritten("\t")).when(F.col("sep") == ";", rewritten(";")).otherwise(F.col("text"))).drop("sep")


# ---------------------------------------------------------------- values broken over lines
def _width(sep: Column, line: str = "text") -> Column:
    return F.size(_cells(F.col(line), sep))


def join_broken(lines: DataFrame) -> DataFrame:
    """Join a quoted value that runs over line breaks, up to its closing quote however far that is, when the joined line
    has the header's width.

    A line with an odd number of quotes opens or closes such a value. Whether an odd line can be joined with the next
    odd one depends on those two and the lines between them alone, so joins are the first, third, fifth ... of each run
    of joinable odd lines: found by counting, not by walking the file. The line after the opening one must not be a full
    row by itself. Over more than five breaks no line between may be one: there a stray quote is likelier than a value
    that reads like rows. Lines that were joined to others go; numbers stay. The file keeps its separator. Only files
    with an odd line are looked at beyond their quote counts, and only values that will be joined are put together."""
    odd = lines.where(csvtext.quote_count(F.col("text")) % 2 == 1)
    mine = lines.join(facts(odd.select(*FILE).distinct()), FILE, "left_semi")
    top = mine.groupBy(*FILE).agg(F.min(F.struct("line_number", "text")).alias("top")).join(separators(mine), FILE) \
        .select(*FILE, "sep", F.col("top.line_number").alias("header_line"), F.size(_cells(F.col("top.text"), F.col("sep"))).alias("width"))
    top = facts(top)
    odd = checkpointed(running(odd.join(top, FILE).where("line_number > header_line"), FILE, [("_blk", line_block(F.col("line_number")))], [F.col("line_number")], {"nth": F.lit(1)}))
    ends = odd.select(*FILE, (F.col("nth") - 1).alias("nth"), F.col("line_number").alias("end"), F.col("text").alias("end_text"))
    opening = F.col("text").rlike(r'^\s*"') | F.when(F.col("sep") == "\t", F.col("text").rlike(r'\t\s*"')).when(F.col("sep") == ";", F.col("text").rlike(r';\s*"')).otherwise(F.col("text").rlike(r',\s*"'))
    opens = (odd.where(opening).select(*FILE, "sep", "nth", F.col("line_number").alias("start"), F.col("text").alias("start_text"), "width")
             .join(ends, [*FILE, "nth"]))
    # each line with the odd line it follows
    marked = latest(mine.join(odd.select(*FILE, "line_number", F.col("line_number").alias("odd")), [*FILE, "line_number"], "left"), "odd", keys=tuple(FILE))
    between = checkpointed(marked.where("odd_at < line_number").select(*FILE, F.col("odd_at").alias("start"), "line_number", "text")
                           .join(opens.select(*FILE, "start", "sep", "nth", "width"), [*FILE, "start"]).withColumn("full", _width(F.col("sep")) == F.col("width")))
    rows = between.groupBy(*FILE, "nth").agg(F.bool_or("full").alias("any_full"), F.bool_or(F.col("full") & (F.col("line_number") == F.col("start") + 1)).alias("next_full"))
    likely = (opens.join(rows, [*FILE, "nth"], "left")
              .where(F.when(F.col("any_full").isNull(), _width(F.col("sep"), "end_text") != F.col("width"))
                     .otherwise(~F.col("next_full") & (~F.col("any_full") | (F.col("end") - F.col("start") <= NEAR_BREAKS)))))
    inside = (between.join(likely.select(*FILE, "nth"), [*FILE, "nth"], "left_semi").groupBy(*FILE, "nth")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "text"))), lambda p: p["text"]).alias("inside")))
    joined = F.array_join(F.concat(F.array("start_text"), F.coalesce("inside", F.array().cast("array<string>")), F.array("end_text")), " ")
    good = checkpointed(likely.join(inside, [*FILE, "nth"], "left").select(*FILE, "sep", "nth", "start", "end", "width", joined.alias("joined"))
                        .where(_width(F.col("sep"), "joined") == F.col("width")))
    state = odd.select(*FILE, "nth").join(good.select(*FILE, "nth", F.lit(True).alias("good")), [*FILE, "nth"], "left")
    runs = latest(state.withColumn("gap", F.when(F.col("good").isNull(), F.col("nth"))), "gap", "nth", tuple(FILE))
    taken = (runs.where(F.col("good").isNotNull() & ((F.col("nth") - F.coalesce("gap_at", F.lit(-1)) - 1) % 2 == 0))
             .select(*FILE, "nth").join(good, [*FILE, "nth"]))
    gone = (taken.select(*FILE, F.col("end").alias("line_number"))
            .union(between.join(taken.select(*FILE, "nth"), [*FILE, "nth"], "left_semi").select(*FILE, "line_number")))
    return (lines.join(gone, [*FILE, "line_number"], "left_anti")
            .join(taken.select(*FILE, F.col("start").alias("line_number"), "joined"), [*FILE, "line_number"], "left")
            .withColumn("text", F.coalesce("joined", "text")).drop("joined"))


# ---------------------------------------------------------------- the header of a report
def _read(lines: DataFrame) -> DataFrame:
    """Each line with its cells and what they look like: how many are filled, whether they could be column names (three
    or more, nearly all of them words, none twice) and whether they are data (two or more numbers or dates)."""
    filled = F.filter(F.transform("cells", lambda c: text.strip(c)), lambda c: c != "")
    valued = F.size(F.filter("shown", lambda c: c.rlike(NUMERIC) | c.rlike(DATE_START)))
    x = lines.withColumn("cells", csvtext.cells(F.col("text"))).withColumn("shown", filled).withColumn("filled", F.size("shown")) \
        .withColumn("valued", F.when(F.col("filled") >= 2, valued).otherwise(0))
    unlike = F.size(F.array_distinct(F.transform("shown", lambda c: F.lower(c)))) == F.col("filled")
    return (x.withColumn("data", F.col("valued") >= 2)
            .withColumn("names", F.when((F.col("filled") >= 3) & (5 * F.col("valued") <= F.col("filled")), unlike).otherwise(False))
            .withColumn("first", text.strip(F.try_element_at("cells", F.lit(1)))).drop("shown", "valued"))


def header_lines(lines: DataFrame) -> DataFrame:
    """(dataset_id, source_file, header_line): see `_places`."""
    return _places(checkpointed(_read(lines).select(*FILE, "line_number", "text", "filled", "data", "names")))


def _places(read: DataFrame) -> DataFrame:
    """Where each file's column names stand, from its lines as `_read` describes them. Aggregates per file:

    * The names are on the first line if that reads like names and the second isn't blank.
    * Otherwise they are the widest line (the first of equals) that reads like names and is wider than a first line that
      does, and stands before the data begins.
    * Data begins with the first line of data; before the first such names, lines of data with four cells or fewer that
      are narrower than later names are skipped ("From, 09/01/2026, To, 09/30/2026").
    * A file with another line of three cells or more before its data is of an unfamiliar layout, and one without such
      names is plain; in both the first line is taken.

    Names are looked for in the first 25 lines, or, if none of those reads like names, up to the 25th line from the
    first that does, however long the words above it."""
    line = F.col("line_number")
    files = read.groupBy(*FILE).agg(F.min("line_number").alias("start"), F.min_by(F.when(F.col("names"), F.col("filled")).otherwise(0), "line_number").alias("base"))
    files = facts(files)
    x = read.join(files, FILE).withColumn("head", F.col("names") & ~F.col("data") & (line > F.col("start")) & (F.col("filled") > F.col("base")))
    seen = x.groupBy(*FILE).agg(F.min(F.when(F.col("head"), line)).alias("named_at"))
    last = F.greatest(F.col("start"), F.when(F.col("named_at") >= F.col("start") + HEADER_SEARCH, F.col("named_at"))) + HEADER_SEARCH
    top = checkpointed(x.join(facts(seen.where("named_at IS NOT NULL")), FILE).where(line < last))

    def earliest(rule: Column) -> Column:
        return F.min(F.when(rule, line))
    narrow = F.col("data") & (line < F.col("named_at"))
    widest = F.max(F.when(F.col("names") & (line > F.col("start")), F.col("filled")))
    told = top.groupBy(*FILE).agg(
        widest.alias("widest"), F.bool_or((line == F.col("start")) & F.col("names")).alias("named_first"),
        F.bool_or((line == F.col("start") + 1) & (text.strip(F.col("text")) != "")).alias("follows"),
        earliest(F.col("data") & ((line > F.col("named_at")) | (F.col("filled") > 4))).alias("wide_at"),
        *[earliest(narrow & (F.col("filled") == n)).alias(f"narrow_{n}") for n in (2, 3, 4)],
        earliest(~F.col("data") & ~F.col("names") & (F.col("filled") > 2)).alias("odd_at"))
    begins = F.least("wide_at", *[F.when(F.col("widest") <= n, F.col(f"narrow_{n}")) for n in (2, 3, 4)])
    far = F.lit((1 << 63) - 1)
    told = told.withColumn("begins", F.coalesce(begins, far)).where(~(F.col("named_first") & F.col("follows")) & (F.coalesce("odd_at", far) >= F.col("begins")))
    best = (top.join(told.select(*FILE, "begins"), FILE).where(F.col("head") & (line < F.col("begins"))).groupBy(*FILE)
            .agg(F.max(F.struct("filled", (-line).alias("from_end"))).alias("best")))
    return files.join(best, FILE, "left").select(*FILE, F.coalesce(-F.col("best.from_end"), "start").alias("header_line"))


# ---------------------------------------------------------------- report-style exports
def classified(lines: DataFrame) -> DataFrame:
    """Every line of a report with what it is: title, header, heading, total, footer, blank or row; and the heading a
    row stands under (`under`)."""
    read = checkpointed(_read(lines).drop("cells"))        # the cells are their text once more
    x = read.join(facts(_places(read)), FILE).drop("data", "names")
    body = F.col("line_number") > F.col("header_line")
    total = F.col("first").rlike(TOTAL)
    alone = (F.col("filled") == 1) & (F.col("first") != "")
    # "Grand total" or "Total for X" alone on a line is a total; the bare word may be a supplier's name
    bare = F.lower(F.rtrim(F.col("first"), F.lit(":"))).isin("total", "totals")
    x = x.withColumn("heading", body & alone & (~total | bare)).withColumn("name_alone", body & alone & ~F.col("first").rlike(NUMERIC))
    last_row = x.where(body & (F.col("filled") >= 2)).groupBy(*FILE).agg(F.max("line_number").alias("last_row"))
    named = (x.where("heading").select(*FILE, F.lower("first").alias("group_name"), "line_number").groupBy(*FILE, "group_name")
             .agg(F.min("line_number").alias("named_at")))
    # lines that name no group have a key of their own, so that they don't all meet in one task
    sums = F.coalesce(F.lower("first").startswith("total "), F.lit(False))
    own = F.when(F.col("sums"), F.btrim(F.expr("substring(lower(first), 7)"))).otherwise(F.col("line_number").cast("string"))
    x = (x.join(facts(last_row), FILE, "left").withColumn("sums", sums).withColumn("group_name", own)
         .join(named.withColumn("sums", F.lit(True)), [*FILE, "sums", "group_name"], "left"))
    kind = (F.when(F.col("line_number") < F.col("header_line"), "title").when(F.col("line_number") == F.col("header_line"), "header")
            .when(F.col("line_number") > F.coalesce("last_row", F.lit(0)), F.when(F.col("filled") > 0, "footer").otherwise("blank"))
            .when(F.col("filled") == 0, "blank").when(F.col("heading"), "heading")
            .when((F.col("first") != "") & (total | (F.col("named_at") < F.col("line_number"))), "total").otherwise("row"))
    x = x.withColumn("kind", kind).withColumn("event", F.when(F.col("kind").isin("heading", "total"), F.col("line_number")))
    x = latest(checkpointed(x), "event", keys=tuple(FILE))
    events = x.where("kind = 'heading'").select(*FILE, F.lit(True).alias("below"), F.col("line_number").alias("event_at"), F.col("first").alias("under"))
    x = x.withColumn("below", F.col("event_at").isNotNull()).withColumn("event_at", F.coalesce("event_at", "line_number"))
    return (x.join(events, [*FILE, "below", "event_at"], "left").withColumn("cells", csvtext.cells(F.col("text")))
            .select(*lines.columns, "cells", "filled", "first", "header_line", "kind", "under", "name_alone"))


def _rest(cells: str) -> Column:
    return F.slice(cells, F.lit(2), F.size(cells))


def tidied(lines: DataFrame) -> DataFrame:
    """Report-style files as plain tables: titles, totals and footers dropped, group headings written into the first
    column. A file with its column names on the first line, a name in the first column, is returned as it is."""
    x = checkpointed(classified(lines).drop("cells")).withColumn("cells", csvtext.cells(F.col("text")))
    heads = x.where("kind = 'header'").select(*FILE, F.col("cells").alias("head"))
    start = lines.groupBy(*FILE).agg(F.min("line_number").alias("start"))
    one_cell = x.groupBy(*FILE).agg(F.bool_or("name_alone").alias("has_headings"))

    def is_name(h: Column) -> Column:
        return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(h, "(?<=[a-z0-9])(?=[A-Z])", " ")), "[^a-z0-9#]+", " ")).isin(NAME_COLUMNS)
    x = x.join(facts(heads.join(start, FILE).join(one_cell, FILE)), FILE)
    first_head = text.strip(F.element_at("head", 1))
    report = (F.size("head") >= 3) & ((F.col("header_line") > F.col("start")) | ((first_head == "") & F.col("has_headings")))
    grouped = (first_head == "") | (is_name(F.element_at("head", 1)) & F.col("has_headings"))
    own_names = F.exists(_rest("head"), is_name)
    fill = grouped & ~own_names & (F.col("first") == "") & F.col("under").isNotNull()
    filled = csvtext.to_line(F.concat(F.array("under"), _rest("cells")))
    new_head = csvtext.to_line(F.when((first_head == "") & F.col("has_headings") & ~own_names, F.concat(F.array(F.lit("Vendor")), _rest("head"))).otherwise(F.col("head")))
    out = F.when(~report, F.col("text")).when(F.col("kind") == "header", new_head).when(fill, filled).otherwise(F.col("text"))
    return x.where(~report | F.col("kind").isin("header", "row")).select(*[c for c in lines.columns if c != "text"], out.alias("text"))


# ---------------------------------------------------------------- line items
def collapse_items(lines: DataFrame) -> DataFrame:
    """Bill exports with a row per line item: of the rows that agree on everything but the item columns, the first."""
    heads = lines.groupBy(*FILE).agg(F.min(F.struct("line_number", "text")).alias("top")) \
        .select(*FILE, F.col("top.line_number").alias("header_line"), csvtext.cells(F.col("top.text")).alias("head"))
    shown = F.transform("head", lambda h: F.btrim(F.regexp_replace(F.lower(F.regexp_replace(h, "(?<=[a-z0-9])(?=[A-Z])", " ")), "[^a-z0-9#]+", " ")))
    heads = heads.withColumn("item", F.transform(shown, lambda h: h.rlike(LINE_ITEM))).withColumn(
        "itemised", F.exists(shown, lambda h: h.rlike(QUANTITY)) & F.exists("item", lambda i: ~i))
    x = lines.join(facts(heads), FILE).withColumn("cells", F.transform(csvtext.cells(F.col("text")), lambda c: text.strip(c)))
    kept = F.filter("cells", lambda c, i: ~F.coalesce(F.try_element_at("item", (i + 1).cast("int")), F.lit(False)))
    x = x.withColumn("bill", F.sha2(F.array_join(kept, "\u0001"), 256)).withColumn("empty", F.forall(kept, lambda c: c == ""))
    first = x.where("itemised AND line_number > header_line AND NOT empty").groupBy(*FILE, "bill").agg(F.min("line_number").alias("first"))
    return (x.join(first, [*FILE, "bill"], "left").where("NOT itemised OR line_number = header_line OR empty OR line_number = first")
            .select(*lines.columns))


