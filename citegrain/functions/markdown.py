"""Markdown lines as array columns: fences, block kinds and plain text, without a shuffle.

Whether a line is code depends on all fences before it. The states between fences (outside, in a block of backticks,
in one of tildes) are functions composed over the fences: chunks of them are summed up as what they make of each
state, the chunks' own states follow from those, and each chunk is then played from its state. All of it is one
expression over a text's lines, linear in their number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

# What counts as white space in the patterns below, and the patterns of each kind of line.
SPACE = r"[\t-\r \xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
BACKTICKS, TILDES = rf"^{SPACE}*```", rf"^{SPACE}*~~~"
HEADING = rf"^(#{{1,3}}){SPACE}+(.*)"
BULLET = rf"^{SPACE}*[-*+]{SPACE}+(.*)"
NUMBERED = rf"^{SPACE}*[0-9]+\.{SPACE}+(.*)"
DIVIDER = rf"^\|(?:{SPACE}|[:|-])+\|$"
# Inline marks in the order in which they go.
INLINE = (
    (r"\*\*\*(.+?)\*\*\*", "$1"), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"__(.+?)__", "$1"), (r"_(.+?)_", "$1"), (r"`(.+?)`", "$1"),
    (r"\[([0-9]+)\]", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"!\[([^\]]*)\]\([^)]*\)", ""),
)
# What plain text is without, in the order in which it goes.
PLAIN = (
    (r"\[([0-9]+)\]", ""), (rf"#{{1,6}}{SPACE}+", ""), (r"(?s)\*\*(.+?)\*\*", "$1"), (r"(?s)\*(.+?)\*", "$1"), (r"(?s)```.*?```", ""), (r"`(.+?)`", "$1"),
    (rf"(?m)^{SPACE}*[-*+]{SPACE}+", ""), (rf"(?m)^{SPACE}*[0-9]+\.{SPACE}+", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\n{3,}", "\n\n"),
)
CHUNK = 256


def _replaced(c: Column, pairs: tuple) -> Column:
    for pattern, to in pairs:
        c = F.regexp_replace(c, pattern, to)
    return c


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def inline_text(c: Column) -> Column:
    """Text without inline marks, citation markers and links' targets; null reads as empty."""
    return trim_space(_replaced(text(c), INLINE))


def plain_text(c: Column) -> Column:
    """A whole answer without marks: headings, bullets, bold, code blocks, links and citations."""
    return trim_space(_replaced(text(c), PLAIN))


def running_states(kinds: Column, any_closes: bool = False) -> Column:
    """The state before each fence of an array of kinds (1: backticks, 2: tildes), and after the last one: 0 outside, else
    the kind of the open block. A block is closed by its own kind, or by either where `any_closes`."""
    step = lambda s, k: F.when(s == 0, k).when(F.lit(any_closes) | (s == k), 0).otherwise(s)
    last = lambda a: F.element_at(a, -1)
    n_chunks = F.ceil(F.size(kinds) / CHUNK).cast("int")
    chunks = F.when(F.size(kinds) > 0, F.transform(F.sequence(F.lit(0), F.greatest(n_chunks - 1, F.lit(0))), lambda i: F.slice(kinds, i * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array().cast("array<array<int>>"))
    makes = F.transform(chunks, lambda c: F.array(*[F.aggregate(c, F.lit(s), step) for s in (0, 1, 2)]))
    starts = F.aggregate(makes, F.array(F.lit(0)), lambda a, m: F.concat(a, F.array(F.get(m, last(a)))))
    played = F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), lambda c, s: F.slice(F.aggregate(c, F.array(s), lambda a, k: F.concat(a, F.array(step(last(a), k)))), F.lit(1), F.size(c)))
    return F.concat(F.flatten(played), F.array(last(starts)))


def fence_kinds(lines: Column) -> Column:
    """0, or the kind of fence that each line is."""
    return F.transform(lines, lambda x: F.when(x.rlike(BACKTICKS), 1).when(x.rlike(TILDES), 2).otherwise(0))


def line_states(kinds: Column, any_closes: bool = False) -> Column:
    """The state before each line, from the lines' kinds of fence: each state between fences, as often as it has lines."""
    at = F.filter(F.transform(kinds, lambda k, i: F.when(k > 0, i)), lambda i: i.isNotNull())
    states = running_states(F.filter(kinds, lambda k: k > 0), any_closes)
    ends = F.concat(at, F.array(F.size(kinds) - 1))
    begins = F.concat(F.array(F.lit(-1)), at)
    return F.flatten(F.zip_with(states, F.zip_with(begins, ends, lambda a, b: b - a), lambda s, n: F.array_repeat(s, n)))
