"""Records out of the two text kinds: contract and invoice lines, and the invoices inside scanned text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.functions import text
from payproof.scale import checkpointed, line_block, running

# --- fixed values: how the two text kinds are written -------------------------
RECORD = r"^\[%s (\S+) \| ([^|]+?) \| ([^\]]+)\] (.*)"
PDF_HEAD = r"^\[PDF (.+)\]$"
AMOUNT = r"(?<![\d.,])(-?\d{1,3}(?:[.,' ]\d{3})+[.,]\d{2}|-?\d{1,12}[.,]\d{2})(?!\d)"
INVOICE_NO = (r"(?i)\binv(?:oice)?\.?\s*(?:no\.?|number|num\.?|#)\s*[:#]?\s*([A-Z]{0,6}[ -]?\d[A-Z0-9/-]*)"
              r"|\binvoice\s*:\s*([A-Z]{1,6}[ -]?\d[A-Z0-9/-]*)")
DATE_LIKE = r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$"
GAP = r"[\s:]*(?:\([^)]{0,30}\)[\s:]*)?(?:(?:USD|EUR|GBP)[\s:]*)?(?:[$€£][\s]*)?"
TOTAL_DUE = r"(?i)\b(?:total due|amount due|balance due|amount payable|total payable)\b" + GAP + AMOUNT
TOTAL = r"(?i)\b(?:invoice total|total)\b" + GAP + AMOUNT
NOT_TOTAL = r"(?i)\b(net|sub)\s*-?\s*total|\bexcl(?:\.|uding)?\b|\b(?:before|pre)[ -]?(?:vat|tax|gst)\b"
BANK = r"(?i)\b(?:account|acct)\b\.?[\s:#*xX-]*(?:(?:no|number)\b\.?[\s:#*xX-]*)?(\d(?:[ -]?\d){3,33})"
IBAN = r"(?i)\bIBAN\b\s*:?\s*([A-Z]{2}\d{2}(?:\s?[A-Z0-9]){10,30})"
NOT_BANK = r"(?i)\b(your|customer|client|cust\.?)\s+(account|acct)|account\s+(ref|reference|manager)"
BANK_CONTEXT = r"(?i)\b(bank|iban|sort code|routing|swift|bic|pay(?:ment)?s? to|remit|beneficiary)\b"
SUPPLIER = r"(?i)^\s*(?:from|supplier|vendor)\s*[:]\s*(.+)$"


def records(lines: DataFrame, kind: str) -> DataFrame:
    """'[CONTRACT id | vendor | where] text' or '[INVOICE ...' lines as columns."""
    pattern = RECORD % kind

    def part(i: int) -> Column:
        return F.regexp_extract("text", pattern, i)
    return (lines.where(F.col("text").rlike(pattern))
            .select("dataset_id", "line_number", part(1).alias("ref"), text.strip(part(2)).alias("vendor"), part(3).alias("place"),
                    part(4).alias("body"), text.norm_name(part(2)).alias("vendor_key")))


def latest(df: DataFrame, value: str, at: str = "line_number", keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Carry the last non-null `value` (which must grow with the lines, like a line number) forward to every row, in
    line order, as `<value>_at`. A block of lines takes what came before it from the block maxima, so no task ever
    walks a whole file."""
    blocked = df.withColumn("_blk", line_block(F.col(at)))
    heads = (blocked.groupBy(*keys, "_blk").agg(F.max(value).alias("_top"))
             .withColumn("_before", F.max("_top").over(Window.partitionBy(*keys).orderBy("_blk")
                                                       .rowsBetween(Window.unboundedPreceding, -1)))
             .select(*keys, "_blk", "_before"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return (blocked.join(heads, [*keys, "_blk"])
            .withColumn(f"{value}_at", F.coalesce(F.max(value).over(inside), F.col("_before"))).drop("_blk", "_before"))


def _features(lines: DataFrame) -> DataFrame:
    """What each line of invoice text says."""
    t = F.col("text")

    def found(pattern: str, i: int = 1) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))
    number = text.strip(F.concat(F.regexp_extract(t, INVOICE_NO, 1), F.regexp_extract(t, INVOICE_NO, 2)))
    bank = F.coalesce(F.regexp_replace(found(IBAN), "[^0-9A-Za-z]", ""), F.regexp_replace(found(BANK), r"\D", ""))
    return (lines.withColumn("head", F.when(t.rlike(PDF_HEAD), F.col("line_number")))
            .withColumn("pdf", found(PDF_HEAD))
            .withColumn("number", F.when((number != "") & ~number.rlike(DATE_LIKE), number))
            .withColumn("total_due", text.strip(found(TOTAL_DUE)))
            .withColumn("total", F.when(~t.rlike(NOT_TOTAL), text.strip(found(TOTAL))))
            .withColumn("bank", F.when(~t.rlike(NOT_BANK) & (F.length(bank) >= 4), bank))
            .withColumn("in_context", t.rlike(BANK_CONTEXT))
            .withColumn("vendor", text.strip(found(SUPPLIER))))


DOC = ["dataset_id", "head_at"]


def _starts(said: DataFrame) -> DataFrame:
    """Where the second and later invoices of each document start, as (dataset_id, head_at, line_number).

    An invoice ends before the first line that has another number than its own and comes after a total. Where the next
    one starts follows from a line alone: `totals` counts the totals before each number line, an opener is the first
    number line after a total, a turn is one whose number isn't the one before it. From a line the next start is the next
    opener, or, if that repeats the line's number, the turn after it. Starts that a document really has are reached from
    its first number by steps of 1, 2, 4, ... starts, so rounds grow with the logarithm of its invoices."""
    of_total, of_number = F.col("total").isNotNull() | F.col("total_due").isNotNull(), F.col("number").isNotNull()
    key = said.where(of_total | of_number).select(*DOC, "line_number", "number", of_total.alias("of_total"))
    levels, order = [("_blk", line_block(F.col("line_number")))], [F.col("line_number")]
    placed = running(key, DOC, levels, order, {"totals": F.col("of_total").cast("int"), "nth": of_number.cast("int")})
    numbers = checkpointed(placed.where(of_number).select(*DOC, "line_number", "number", "totals", "nth"))
    before = numbers.select(*DOC, (F.col("nth") + 1).alias("nth"), F.col("number").alias("before"))
    turns = numbers.join(before, [*DOC, "nth"], "left").withColumn("turn", (F.col("before").isNull() | (F.col("number") != F.col("before"))).cast("int"))
    opener = numbers.groupBy(*DOC, "totals").agg(F.min("line_number").alias("line_number")).withColumn("opener", F.lit(1))
    x = turns.join(opener, [*DOC, "totals", "line_number"], "left").select(*DOC, "line_number", "number", "totals", "turn", F.coalesce("opener", F.lit(0)).alias("opener"))
    # the run of equal numbers and the stretch between totals each line belongs to, numbered from 1
    x = running(x, DOC, levels, order, {"runs": F.col("turn"), "parts": F.col("opener")})
    x = checkpointed(x.where("turn = 1 OR opener = 1").withColumn("run", F.col("runs") + F.col("turn")).withColumn("part", F.col("parts") + F.col("opener")))
    turn = x.where("turn = 1").select(*DOC, (F.col("run") - 1).alias("run"), F.col("line_number").alias("other"))
    onward = x.join(turn, [*DOC, "run"], "left")                               # the first line with another number
    opens = onward.where("opener = 1").select(*DOC, (F.col("part") - 1).alias("part"), F.col("line_number").alias("open"), F.col("number").alias("open_number"),
                                              F.col("other").alias("open_other"))
    steps = onward.join(opens, [*DOC, "part"], "left").withColumn("next", F.when(F.col("open_number") != F.col("number"), F.col("open")).otherwise(F.col("open_other")))
    # an invoice that starts with its document may have its total before its number
    first = steps.where("run = 1 AND turn = 1").select(*DOC, F.when(F.col("totals") > 0, F.col("other")).otherwise(F.col("next")).alias("line_number"))
    got = checkpointed(first.where("line_number IS NOT NULL"))
    hop = checkpointed(steps.where("next IS NOT NULL").select(*DOC, "line_number", "next").join(got.select(*DOC), DOC, "left_semi"))
    reached = got
    while True:
        got = checkpointed(reached.join(hop, [*DOC, "line_number"]).select(*DOC, F.col("next").alias("line_number")))
        if got.isEmpty():
            return reached
        reached = checkpointed(reached.union(got))
        hop = checkpointed(hop.join(hop.select(*DOC, F.col("line_number").alias("next"), F.col("next").alias("then")), [*DOC, "next"])
                           .select(*DOC, "line_number", F.col("then").alias("next")))


def invoice_blocks(lines: DataFrame) -> DataFrame:
    """One row per invoice found in the text: the first number and total due (or total) it gives, the first account named
    beside bank words (or the first one), and the supplier.

    A document holds one invoice until a new number comes after a total (`_starts`). The document's first supplier line
    holds from its invoice on; where none came before it, the words under the document's head stand in (`guess`), or
    else the line that starts a further invoice. All of it is joins and aggregates by document and invoice: no task holds
    a document."""
    f = latest(_features(lines), "head").where("head_at IS NOT NULL")
    body, line = F.col("line_number") > F.col("head_at"), F.col("line_number")
    fields = ["number", "total_due", "total", "bank", "vendor"]
    second = line == F.col("head_at") + 1
    f = f.select(*DOC, "line_number", "pdf", *[F.when(body, F.col(c)).alias(c) for c in fields], "in_context",
                 F.when(second | (F.col("number").isNotNull() & body), text.strip(F.col("text"))).alias("words"), second.alias("second"))
    said = checkpointed(f.where(~body | F.col("second") | F.coalesce(*fields).isNotNull()))
    starts = _starts(said).withColumn("starts", F.lit(True))
    x = said.join(starts, [*DOC, "line_number"], "left").withColumn("block", F.when(~body | F.col("starts"), line))
    x = checkpointed(latest(x, "block", keys=tuple(DOC)))

    def earliest(value: str, *more: str, rule: Column | None = None) -> Column:
        return F.min(F.when(F.col(value).isNotNull() if rule is None else rule, F.struct("line_number", value, *more)))
    docs = x.groupBy(*DOC).agg(F.max(F.when(~body, F.col("pdf"))).alias("pdf"), earliest("vendor", "block_at").alias("v"),
                               earliest("words", "block_at", rule=F.col("second") | F.col("starts")).alias("g"))
    own = F.min(F.when(F.col("bank").isNotNull(), F.struct((~F.col("in_context")).alias("elsewhere"), "line_number", "bank")))
    blocks = x.groupBy(*DOC, "block_at").agg(earliest("number").alias("n"), earliest("total_due").alias("due"), earliest("total").alias("t"), own.alias("b"))
    blocks = running(blocks, DOC, [("_blk", line_block(F.col("block_at")))], [F.col("block_at")], {"nth": F.lit(1)}).join(docs, DOC)
    further, known = F.col("nth") > 0, F.col("v.block_at") <= F.col("block_at")
    guessed = (F.col("g.block_at") <= F.col("block_at")) & (F.col("v").isNull() | (F.col("v.line_number") > F.col("g.line_number")))
    name = F.when(further, F.concat(F.substring_index("pdf", " #", 1), F.lit(" #"), F.col("nth") + 1)).otherwise(F.col("pdf"))
    return blocks.select("dataset_id", (F.col("block_at") - further.cast("int")).alias("start"), name.alias("name"),
                         F.col("n.line_number").alias("number_line"), F.col("n.number").alias("number"),
                         F.coalesce("due.line_number", "t.line_number").alias("total_line"), F.coalesce("due.total_due", "t.total").alias("total"),
                         F.col("b.line_number").alias("bank_line"), F.col("b.bank").alias("bank"),
                         F.when(known, F.col("v.line_number")).alias("vendor_line"), F.when(known, F.col("v.vendor")).alias("vendor"),
                         F.when(guessed, F.col("g.line_number")).alias("guess_line"), F.when(guessed, F.col("g.words")).alias("guess"))
