"""Readers and writers of the ledger's own files: JSON lines, the scan history, the pending list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import clean_field, role_key, url_key

DECISION = "ts timestamp, id bigint, company string, title string, location string, url string, reason string, longshot boolean"
VERDICT = "ts timestamp, id bigint, state string, reason string"
JUDGEMENT = (
    "ts timestamp, id bigint, company string, title string, url string, source string, bot_decision string, council string, user_decision string, "
    "verdicts map<string,struct<vote:string,reason:string,confidence:double,failed:boolean>>"
)
HISTORY = "url string, first_seen date, portal string, title string, company string, status string, location string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema; lines that cannot be read are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    names = [f.name for f in rows.schema if f.name != "_corrupt_record"]
    # any good line has at least one field
    return rows.filter(F.col("_corrupt_record").isNull() & F.coalesce(*[F.col(n).cast("string") for n in names if n != "verdicts"]).isNotNull()).select(*names)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The scan history, tab-separated with a header."""
    return spark.read.schema(HISTORY).option("sep", "\t").option("header", True).csv(path)


def append_history(rows: DataFrame, path: str) -> None:
    names = [part.split()[0] for part in HISTORY.split(", ")]
    rows.select(*names).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def parse_pending(lines: DataFrame) -> DataFrame:
    """Rows of a pending list from (line_no, line).

    ``- [ ] url | company | title [| location] [| y:N] [| s:salary] | #id [| visto]``: fields
    after the title are told by their form, and the first of no form is the location.
    """
    parts = F.transform(F.split(F.regexp_replace("line", r"^- \[[ x]\] ", ""), r"\|"), lambda p: F.trim(p))
    rows = lines.filter(F.col("line").rlike(r"^- \[[ x]\] \S+")).select("line_no", "line", parts.alias("p"))
    more = F.when(F.size("p") > 3, F.slice("p", 4, 100)).otherwise(F.array())
    tagged = lambda pattern: F.try_element_at(F.filter("more", lambda x: x.rlike(pattern)), F.lit(1))
    rows = rows.withColumn("more", more)
    return rows.select(
        "line_no",
        F.element_at("p", 1).alias("url"), F.try_element_at("p", F.lit(2)).alias("company"), F.try_element_at("p", F.lit(3)).alias("title"),
        F.try_element_at(F.filter("more", lambda x: ~x.rlike(r"^(?:y:\d+|s:.*|#\d+|visto)$") & (x != "")), F.lit(1)).alias("location"),
        F.regexp_extract(tagged(r"^y:\d+$"), r"(\d+)", 1).cast("int").alias("years"),
        F.nullif(F.regexp_replace(tagged("^s:"), "^s:", ""), F.lit("")).alias("salary"),
        F.regexp_extract(tagged(r"^#\d+$"), r"(\d+)", 1).cast("long").alias("id"),
        F.col("line").rlike(r"^- \[x\]").alias("checked"), tagged("^visto$").isNotNull().alias("by_user"),
    )


def pending_line() -> Column:
    """A pending row as its line."""
    field = lambda c: clean_field(F.col(c))
    tail = F.array_compact(
        F.array(
            F.nullif(field("location"), F.lit("")), F.when(F.col("years").isNotNull(), F.concat(F.lit("y:"), F.col("years").cast("string"))),
            F.when(F.coalesce("salary", F.lit("")) != "", F.concat(F.lit("s:"), field("salary"))),
            F.when(F.col("id").isNotNull(), F.concat(F.lit("#"), F.col("id").cast("string"))), F.when(F.col("by_user"), "visto"),
        )
    )
    head = F.concat(F.lit("- ["), F.when(F.col("checked"), "x").otherwise(" "), F.lit("] "), F.col("url"))
    return F.concat_ws(" | ", head, field("company"), field("title"), F.array_join(tail, " | "))


def blocking_roles(pending: DataFrame) -> DataFrame:
    """Role keys a pending list blocks: open rows, and checked ones that the user checked."""
    return pending.filter("NOT checked OR by_user").select(role_key("company", "title").alias("role_key")).filter("role_key IS NOT NULL").distinct()


def seen_urls(*tables: DataFrame) -> DataFrame:
    """(url_key) over all stores."""
    keys = [t.select(url_key("url").alias("url_key")) for t in tables]
    out = keys[0]
    for other in keys[1:]:
        out = out.unionByName(other)
    return out.filter("url_key <> ''").distinct()


def seen_roles(pending: DataFrame, *tables: DataFrame) -> DataFrame:
    """(role_key) over the pending list and the decision tables."""
    out = blocking_roles(pending)
    for t in tables:
        out = out.unionByName(t.select(role_key("company", "title").alias("role_key")))
    return out.filter("role_key IS NOT NULL").distinct()


def section(lines: DataFrame, heading: str) -> DataFrame:
    """The lines of a document (doc, line_no, line) under a second-level heading."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc").orderBy("line_no")
    under = F.last(F.when(F.col("line").startswith("## "), F.trim(F.substring("line", 4, 1000))), ignorenulls=True).over(order)
    return lines.withColumn("under", under).filter((F.col("under") == heading) & ~F.col("line").startswith("## ")).drop("under")
