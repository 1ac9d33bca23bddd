"""Word rules compiled to patterns that Java's and RE2's regular expressions read alike.

Borders are consuming classes instead of ``\\b``, so no lookaround is needed and accented
letters count the same everywhere. Patterns are matched against folded text.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

LEFT, RIGHT = "(?:^|[^a-z0-9_])", "(?:[^a-z0-9_]|$)"
PLURAL = "(?:s|es|en|in|innen)?"
ACRONYM = re.compile(r"[A-Z0-9.&-]{2,6}")
#: Matches nothing: the pattern of an empty rule list.
NEVER = "[^\\s\\S]"


def folded(text: str) -> str:
    """Lower case without accents, as :func:`quarryline.functions.text.fold` does it in Spark."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not 0x300 <= ord(c) <= 0x36F).lower()


def literal(text: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)


def bounded(term: str, plural: bool = False) -> str:
    """A pattern for a term as a whole word; ``*term`` may begin inside one, ``plural`` allows endings."""
    inside = term.startswith("*")
    text = folded(term[1:] if inside else term)
    left = LEFT if not inside and re.match(r"[a-z0-9_]", text) else ""
    right = (PLURAL if plural else "") + RIGHT if re.search(r"[a-z0-9_]$", text) else ""
    return left + literal(text) + right


def among_letters(term: str) -> str:
    """A pattern for a term as a whole word, where letters and digits of any script count, ``ß`` and ``ø`` included."""
    text = folded(term)
    left = r"(?:^|[^\p{L}\p{Nd}])" if text[:1].isalnum() else ""
    right = r"(?:[^\p{L}\p{Nd}]|$)" if text[-1:].isalnum() else ""
    return left + literal(text) + right


def either(patterns: list[str]) -> str:
    """One alternation; an empty list matches nothing."""
    return "|".join(f"(?:{p})" for p in patterns) if patterns else NEVER


def listed_pattern(fragments: list[str] | None, default: str) -> str:
    """A configured list of fragments as one pattern.

    A missing list means the default, an empty one switches the rule off. Fragments that do not
    compile are left out; if none does, the default stays.
    """
    if fragments is None:
        return default
    if not fragments:
        return NEVER
    valid = []
    for fragment in fragments:
        try:
            re.compile(str(fragment))
            valid.append(str(fragment))
        except re.error:
            continue
    return either(valid) if valid else default


@dataclass(frozen=True)
class Rule:
    """A blocked term, and the terms that rescue a text that has it."""

    term: str
    unless: tuple[str, ...] = ()

    @property
    def pattern(self) -> str:
        return bounded(self.term, plural=True)

    @property
    def rescue(self) -> str:
        return either([bounded(u, plural=True) for u in self.unless])
