"""Messages from their nested raw form."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import html_text
from quarryline.session import ship_package

BODY_CHARS = 20_000


def header(headers: Column, name: str) -> Column:
    """The first header of a name, whatever its case, of an array of (name, value)."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.try_element_at(found, F.lit(1))["value"]


def _bodies(part: dict, kind: str) -> list[str]:
    """Decoded texts of a type in a tree of parts, depth first, without recursion."""
    found, stack = [], [part]
    while stack:
        node = stack.pop()
        if not isinstance(node, dict):
            continue
        data = (node.get("body") or {}).get("data")
        if node.get("mimeType") == kind and data:
            padded = data + "=" * (-len(data) % 4)
            found.append(base64.urlsafe_b64decode(padded).decode("utf-8", "replace"))
        stack += reversed(node.get("parts") or [])
    return found


def plain_and_html(payload: Column) -> Column:
    """(plain, html) of a message's JSON part tree; trees have no fixed depth, hence a Python function."""

    ship_package()

    @F.pandas_udf("plain string, html string")
    def walk(payloads: pd.Series) -> pd.DataFrame:
        import json

        rows = []
        for text in payloads:
            try:
                tree = json.loads(text) if text else {}
                rows.append(("\n".join(_bodies(tree, "text/plain")), "\n".join(_bodies(tree, "text/html"))))
            except ValueError:
                rows.append(("", ""))
        return pd.DataFrame(rows, columns=["plain", "html"])

    return walk(payload)


def message_rows(raw: DataFrame) -> DataFrame:
    """(id, from, subject, date, snippet, body) of raw messages (id, snippet, headers, payload).

    Plain text wins over markup; a body is cut at BODY_CHARS, the length that a message's
    kind was found to need, as part of what the row is.
    """
    parts = plain_and_html(F.col("payload"))
    body = F.coalesce(F.nullif(F.trim("parts.plain"), F.lit("")), html_text("parts.html"))
    sent = F.to_timestamp(F.regexp_extract(header(F.col("headers"), "Date"), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})", 1), "d MMM yyyy HH:mm:ss Z")
    return raw.withColumn("parts", parts).select(
        "id", header(F.col("headers"), "From").alias("from"), header(F.col("headers"), "Subject").alias("subject"), sent.alias("date"),
        "snippet", F.left(body, F.lit(BODY_CHARS)).alias("body"),
    )
