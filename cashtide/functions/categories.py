"""Revenue streams from charge descriptions, by ordered rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class StreamRule:
    """``stream`` wins when the pattern is found anywhere, or the trimmed text is listed."""

    stream: str
    pattern: str | None = None  # case-insensitive, anywhere in the text
    exact: tuple[str, ...] = ()  # case-sensitive, after trimming

    def matches(self, text: Column) -> Column:
        hit = F.lit(False)
        if self.pattern is not None:
            hit = hit | text.rlike(f"(?i){self.pattern}")
        if self.exact:
            hit = hit | trimmed(text).isin(*self.exact)
        return hit


# The first matching rule decides.
DEFAULT_RULES = (
    StreamRule("league", pattern="IV League"),
    StreamRule("recurring", exact=("Subscription update", "Subscription creation")),
)
FALLBACK_STREAM = "one_time"


# All code points that Unicode counts as white space, and the four ASCII separators.
WHITE_SPACE = "".join(
    map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)


def trimmed(text: Column) -> Column:
    """Text without leading or trailing white space of any kind; no regular expression per row."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def stream_of(
    text: Column, rules: tuple[StreamRule, ...] = DEFAULT_RULES, fallback: str = FALLBACK_STREAM
) -> Column:
    """Stream of a description; blank, missing and unmatched text goes to the fallback."""
    blank = trimmed(F.coalesce(text, F.lit(""))) == ""
    chosen = F.when(blank, fallback)
    for rule in rules:
        chosen = chosen.when(rule.matches(text), rule.stream)
    return chosen.otherwise(fallback)
