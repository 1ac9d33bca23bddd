"""Word-rule gates: the verdict as one pattern, the reason only where something is dropped."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.patterns import ACRONYM, Rule, among_letters, bounded, either, folded, literal
from quarryline.functions.text import fold, trimmed

NO_FIELD, RULE = "no-field", "rule"


def _first_label(text: Column, labelled: list[tuple[str, Column]]) -> Column:
    """The label of the first condition that holds, in list order; null if none does."""
    out = F.lit(None).cast("string")
    for label, hit in reversed(labelled):
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


@dataclass(frozen=True)
class TitleRules:
    """What a title must have (any of ``positive``) and must not have.

    No positive terms let every title through that test. Short upper-case terms are acronyms and
    match as words, all others anywhere. A negative rule allows plural endings and is waived
    where one of its ``unless`` terms stands in the title.
    """

    positive: tuple[str, ...] = ()
    negative: tuple[Rule, ...] = ()

    def has_positive(self, title: Column | str) -> Column:
        if not self.positive:
            return F.lit(True)
        patterns = [bounded(t) if ACRONYM.fullmatch(t) else literal(folded(t)) for t in self.positive]
        return fold(title).rlike(either(patterns))

    def _hit(self, text: Column, rule: Rule) -> Column:
        hit = text.rlike(rule.pattern)
        return hit & ~text.rlike(rule.rescue) if rule.unless else hit

    def blocked(self, title: Column | str) -> Column:
        """Any negative rule holds: the plain ones as one alternation."""
        text = fold(title)
        out = text.rlike(either([r.pattern for r in self.negative if not r.unless]))
        for rule in self.negative:
            if rule.unless:
                out |= self._hit(text, rule)
        return out

    def passes(self, title: Column | str) -> Column:
        return self.has_positive(title) & ~self.blocked(title)

    def blocking_term(self, title: Column | str) -> Column:
        """The first negative term, in list order, that holds."""
        text = fold(title)
        return _first_label(text, [(r.term, self._hit(text, r)) for r in self.negative])

    def reason(self, title: Column | str) -> Column:
        """Why a title is dropped; null if it passes."""
        term = self.blocking_term(title)
        return (
            F.when(~self.has_positive(title), "the title has no word of the field")
            .when(self.blocked(title), F.concat(F.lit('the title has the blocked word "'), term, F.lit('"')))
        )

    def bucket(self, title: Column | str) -> Column:
        """``rule`` if a title would be dropped even without positive terms, ``no-field`` if only for them."""
        return F.when(self.blocked(title), RULE).when(~self.has_positive(title), NO_FIELD)


def blocked_term(value: Column | str, terms: tuple[str, ...]) -> Column:
    """The first term that a text has as a whole word; null if it has none."""
    text = fold(value)
    return F.when(text.rlike(either([bounded(t) for t in terms])), _first_label(text, [(t, text.rlike(bounded(t))) for t in terms]))


@dataclass(frozen=True)
class LocationRules:
    """Places that are allowed (substrings; none means all) and blocked (whole words, stronger)."""

    allow: tuple[str, ...] = ()
    block: tuple[str, ...] = ()

    def blocks(self, text: Column | str) -> Column:
        return fold(text).rlike(either([bounded(t) for t in self.block]))

    def one(self, place: Column) -> Column:
        allowed = F.lit(True) if not self.allow else fold(place).rlike(either([literal(folded(a)) for a in self.allow]))
        return ~self.blocks(place) & allowed

    def passes(self, location: Column | str) -> Column:
        """An empty location passes; of several seats (``;``) any one is enough."""
        text = F.coalesce(F.col(location) if isinstance(location, str) else location, F.lit(""))
        places = seats(text)
        return (text == "") | F.when(F.size(places) > 0, F.exists(places, self.one)).otherwise(self.one(text))


def seats(location: Column) -> Column:
    return F.filter(F.transform(F.split(location, ";"), trimmed), lambda p: p != "")


OFF_WORDS = ("no", "off", "false")


def switched_off(enabled: Column) -> Column:
    """A switch that is written off in any of its usual forms."""
    return F.lower(F.trim(enabled.cast("string"))).isin(*OFF_WORDS)


@dataclass(frozen=True)
class Country:
    name: str
    enabled: str = "yes"
    aliases: tuple[str, ...] = ()

    @property
    def off(self) -> bool:
        return str(self.enabled).strip().lower() in OFF_WORDS

    @property
    def pattern(self) -> str:
        return either([bounded(a) for a in (self.name, *self.aliases)])


@dataclass(frozen=True)
class CountryRules:
    countries: tuple[Country, ...] = field(default_factory=tuple)

    def passes(self, location: Column | str) -> Column:
        """False where a location names a country that is switched off; unknown places pass."""
        return ~fold(location).rlike(either([c.pattern for c in self.countries if c.off]))


def names_priority(title: Column | str, body: Column | str, terms: tuple[str, ...]) -> Column:
    """A term of the user's priorities stands in the title or the body, as a whole word; it waives years and degrees."""
    text = F.concat_ws(" ", F.coalesce(_column(title), F.lit("")), F.coalesce(_column(body), F.lit("")))
    return fold(text).rlike(either([among_letters(t) for t in terms]))


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
