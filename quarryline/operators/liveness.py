"""Is an offer still open? Verdicts from what a fetch brought back, careful not to lose one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.phrases import APPLY_CONTROL, APPLY_SIGNAL, CLOSED, LISTING

#: Of the closing phrases, those that a notice about something else may contain.
GENERIC = tuple(p for p in CLOSED if p.startswith(("applications?", "closed on")))
LEAST_CHARS = 300
EXPIRED, ACTIVE, UNCERTAIN = "expired", "active", "uncertain"


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first pattern, in order, that a lower-case text matches; null if none does."""
    out = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), F.lit(pattern)).otherwise(out)
    return out


def has_apply_control(controls: Column) -> Column:
    words = "|".join(APPLY_CONTROL)
    return F.coalesce(F.exists(controls, lambda c: F.lower(c).rlike(words)), F.lit(False))


def apply_signal(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(APPLY_SIGNAL)


def liveness(status: Column, final_url: Column, body: Column, controls: Column) -> Column:
    """(result, reason) of a fetch.

    Gone is gone; an error proves nothing; then the address, closing phrases, a way to apply, a
    listing instead of an offer, and too little text. A generic closing phrase is overruled by
    a way to apply in the text.
    """
    status = F.coalesce(status, F.lit(0))
    text = F.lower(F.coalesce(body, F.lit("")))
    closed, listing = first_match(text, CLOSED), first_match(text, LISTING)
    overruled = closed.isin(*GENERIC) & apply_signal(body)

    def verdict(result: str, reason: Column) -> Column:
        return F.struct(F.lit(result).alias("result"), reason.alias("reason"))

    return (
        F.when(status.isin(404, 410), verdict(EXPIRED, F.concat(F.lit("HTTP "), status.cast("string"))))
        .when((status == 0) | (status >= 400), verdict(UNCERTAIN, F.lit("the page could not be read")))
        .when(F.coalesce(final_url, F.lit("")).rlike("(?i)[?&]error=true"), verdict(EXPIRED, F.lit("redirected to an error page")))
        .when(overruled, verdict(ACTIVE, F.lit("a way to apply despite a closing phrase")))
        .when(closed.isNotNull(), verdict(EXPIRED, F.concat(F.lit("phrase: "), closed)))
        .when(has_apply_control(controls), verdict(ACTIVE, F.lit("a way to apply")))
        .when(listing.isNotNull(), verdict(EXPIRED, F.concat(F.lit("listing: "), listing)))
        .when(F.length(F.trim(text)) < LEAST_CHARS, verdict(EXPIRED, F.lit("insufficient content")))
        .otherwise(verdict(UNCERTAIN, F.lit("content without a way to apply")))
    )


def is_dead(verdict: Column) -> Column:
    """Expired on evidence; thin pages are not evidence."""
    return (verdict["result"] == EXPIRED) & ~F.contains(verdict["reason"], F.lit("insufficient content"))


def portal_dead(portal: Column, status: Column, has_items: Column, body: Column) -> Column:
    """What a portal's own interface says: true, false, or null where it says nothing.

    ``api_list`` is dead with an empty answer; ``api_item`` also when it refuses; ``details`` only
    when gone; ``card`` when gone or closed in words. Other answers keep the offer.
    """
    ok = status.between(200, 299)
    return (
        F.when(portal == "api_list", ok & ~F.coalesce(has_items, F.lit(True)))
        .when(portal == "api_item", status.isin(403, 404) | (ok & ~F.coalesce(has_items, F.lit(True))))
        .when(portal == "details", status.isin(404, 410))
        .when(portal == "card", (status == 404) | (ok & F.contains(F.lower(F.coalesce(body, F.lit(""))), F.lit("no longer accepting"))))
    )
