"""Grouping, order and paging of what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import fold
from quarryline.operators.ordering import numbered, running
from quarryline.operators.rules import Country
from quarryline.operators.stretches import Pages, walk

NO_LOCATION, REMOTE, OTHER = "NO LOCATION", "REMOTE", "OTHER"


def location_group(location: Column, home: tuple[str, str] | None, countries: tuple[Country, ...], labels: dict[str, str] | None = None) -> Column:
    """The heading a location goes under: none, the home city, the first country that it names, remote, or other."""
    text = fold(location)
    out = F.when(F.trim(text) == "", NO_LOCATION)
    if home:
        out = out.when(F.contains(text, F.lit(home[0].lower())), home[1])
    for country in countries:
        out = out.when(text.rlike(country.pattern), (labels or {}).get(country.name, country.name.upper()))
    return out.when(text.rlike("remote|hybrid"), REMOTE).otherwise(OTHER)


def url_hint(url: Column, domains: dict[str, str]) -> Column:
    """A heading from the country part of an address, or null."""
    code = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://[^/]*\.([a-z]{2})/", 1))
    out = F.lit(None).cast("string")
    for domain, label in domains.items():
        out = F.when(code == domain, label).otherwise(out)
    return out


def group_of(location_heading: Column, hint: Column) -> Column:
    """The hint counts only where the location says nothing."""
    return F.when(location_heading.isin(OTHER, NO_LOCATION), F.coalesce(hint, location_heading)).otherwise(location_heading)


def group_order(rows: DataFrame, group: str, affinity: str, seq: str, order: tuple[str, ...]) -> DataFrame:
    """Rows with their place: groups in the given order, the best affinity first, then as they came."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(group)).cast("int")
    return numbered(rows, F.when(rank > 0, rank).otherwise(len(order) + 1), F.desc(affinity), F.col(seq))


def pack_rows(rows: DataFrame, key: str, order: tuple[str, ...], size: str, budget: int) -> DataFrame:
    """``rows`` with ``page``: for each key, items in order go on a page as long as they fit; a larger one stands alone."""
    return walk(with_layout(rows, size, F.lit(0), F.lit(False), F.lit(0)), key, order, Pages(budget, LAYOUT), "page", "long").drop(*LAYOUT)


#: Columns of a page's layout: sizes of line and heading, whether the line opens its group, room that the heading asks for.
LAYOUT = ("q_size", "q_head", "q_opens", "q_room")


def with_layout(rows: DataFrame, size, head, opens, room) -> DataFrame:
    whole = lambda value: F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0)).cast("long")
    return rows.withColumns({"q_size": whole(size), "q_head": whole(head), "q_opens": opens, "q_room": whole(room)})


def pack_groups(rows: DataFrame, key: str, group: str, order: tuple[str, ...], size: str, head: Column, budget: int, spare: int = 3) -> DataFrame:
    """``rows`` with ``page``: lines of a list under the headings of their groups, which are repeated on each page that goes on.

    ``order`` keeps the lines of a group together and tells those of a key apart; ``head`` is the rendered
    size of a heading. A group begins on the page only if its heading and ``spare`` more fit, and a line
    only if its whole rendered size does.
    """
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    firsts = rows.groupBy(F.col(key).alias("q_key"), F.col(group).alias("q_group")).agg(F.min(place).alias("q_first"))
    met = rows.join(firsts, F.col(key).eqNullSafe(F.col("q_key")) & F.col(group).eqNullSafe(F.col("q_group")))
    laid = with_layout(met.drop("q_key", "q_group"), size, head, place == F.col("q_first"), head + spare).drop("q_first")
    return walk(laid, key, order, Pages(budget, LAYOUT), "page", "long").drop(*LAYOUT)


def within_budget(rows: DataFrame, size: str, budget: int, order: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """The first rows, in order, whose sizes fit into the budget together; it stops at the first that does not.

    Sums run over ranges of the order, so all rows may be one list.
    """
    return running(rows, by, order, size, "used").filter(F.col("used") <= budget)


def new_since(ids: DataFrame, seen: DataFrame) -> DataFrame:
    """Ids with ``is_new``; without anything ever seen, nothing is new."""
    known = seen.select(F.col("id").alias("seen_id")).distinct()
    some = seen.agg((F.count(F.lit(1)) > 0).alias("some"))
    joined = ids.join(known, F.col("id") == F.col("seen_id"), "left").crossJoin(F.broadcast(some))
    return joined.select(*ids.columns, (F.col("seen_id").isNull() & F.col("some")).alias("is_new"))
