"""Who a finding is about."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.functions.text import strip

CONTRACT_RECORD = r"^\[(?:CONTRACT|INVOICE) \S+ \| ([^|]+?) \|"


def entity(source_file: Column, header: Column, values: Column, evidence: Column, invoice_vendor: Column) -> Column:
    """The supplier, employee or vendor id a finding's line names: the column that says so in its kind of file, the
    supplier of the invoice it lies in, the vendor of a contract line, else the line."""
    wanted = F.coalesce(*[F.when(source_file == f, F.lit(c)) for f, c in S.ENTITY_COLUMN.items()])
    place = F.array_position(header, wanted).cast("int")
    cell = F.when((place > 0) & (F.size(header) == F.size(values)), strip(F.try_element_at(values, place)))
    contract = F.regexp_extract(evidence, CONTRACT_RECORD, 1)
    return F.coalesce(F.when((source_file == "invoices.txt") & (strip(invoice_vendor) != ""), strip(invoice_vendor)), cell,
                      F.when(contract != "", strip(contract)), strip(evidence))
