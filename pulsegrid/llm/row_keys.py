"""Keys that tell the rows of a table of documents apart, also where ids repeat or are null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.scratch import stored

#: Stands for a null id; such documents come last in the order of documents.
NO_ID = (1 << 63) - 1


def with_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with __doc, which orders them, and __row, which tells documents of one __doc apart.

    __row is 0 where all ids differ, else a hash of the text, so rows that repeat id and text share it.
    Rows with a null id get a number instead and are stored, so that it stays theirs.
    """
    doc, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    named = docs.where(doc.isNotNull())
    repeated = named.groupBy(doc.alias("__doc")).agg(F.count("*").alias("__n")).where("__n > 1")
    own = F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64(text)
    named = named.withColumns({"__doc": doc, "__row": own})
    nameless = docs.where(doc.isNull())
    if nameless.select(id_col).isEmpty():
        return named
    numbered = nameless.withColumns({"__doc": F.lit(NO_ID).cast("long"), "__row": F.monotonically_increasing_id()})
    return named.unionByName(stored(numbered, "nameless"))
