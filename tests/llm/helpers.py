"""Small documents tables with awkward rows."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
LONG = "river stone lantern harbour " * 60_000


def documents(spark, rows, extra: str = ""):
    """Rows of (doc_id, text, ...) filled up with nulls; ``extra`` names further columns of text."""
    names = [part.split()[0] for part in DOCS.split(", ")]
    full = [tuple(row) + (None,) * (len(names) - len(row)) for row in rows]
    table = spark.createDataFrame(full, DOCS)
    for name in extra.split():
        table = table.selectExpr("*", "'x' AS `{}`".format(name.replace("`", "``")))
    return table


def by_id(df) -> dict:
    return {row.doc_id: row for row in df.collect()}
