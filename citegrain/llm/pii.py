"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (Luhn and mod-97 checks, calendar dates, numbering plans,
octet ranges). Each is ranked among all values of its format, the rank is permuted by a keyed Feistel
network with cycle walking, and the result is written back in the same layout, check digits included.
The permutation depends on the key and the value alone, so equal values keep one pseudonym in all
documents, and who has the key can undo it. The key is a secret of the caller's.

A card or IBAN that runs on into other groups is tried shorter, down to each separator, and from later
groups on. Such tries take only cards in groups of four digits and more, but for the last, as any row of
small numbers holds sums that check. Where two numbers touch, undoing can meet another split.

Not found are values without their marks (ten or nine bare digits as a phone or social security number), cards
in groups parted by dots, digits of other scripts than ASCII, IPv6 addresses of fewer than four groups or in
upper case, and dates outside the years 1800 to 2099: too much else looks like them.

Null texts stay null with 0 found; texts without a match are returned as they are. Texts of any
length are searched whole; repeated rows get equal results. All other columns pass through; a column
called like an added one is replaced.
"""

from __future__ import annotations

import datetime
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ROUNDS = 8
DIGITS = "0123456789"
KINDS = ("email", "phone", "card", "ssn", "iban", "ip", "date", "secret")
#: Hexadecimal groups that an IPv6 address tells at least.
IPV6_GROUPS = 4


def permute(rank: int, size: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """A keyed permutation of range(size)."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, n_bytes = (1 << half) - 1, (half + 7) // 8
    tweaked = tweak.encode()

    def f(i: int, value: int) -> int:
        out, block = b"", 0
        while len(out) < n_bytes:
            out += blake2b(value.to_bytes(n_bytes) + bytes([i, block & 255]) + tweaked, key=key[:64], digest_size=64).digest()
            block += 1
        return int.from_bytes(out[:n_bytes]) & mask

    while True:
        left, right = rank >> half, rank & mask
        if undo:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ f(i, left), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ f(i, right)
        rank = left << half | right
        if rank < size:
            return rank


Step = Callable[[int, int, str], int]  #: (rank, size, tweak) to the new rank


#: Longer values are spelled in blocks.
SPELLED_CHARS = 200


def _spelled(value: str, step: Step, tweak: str, hexadecimal: bool = False) -> str:
    """Letters become letters of their case, digits digits; other characters stay. Blocks are linked by
    both spellings of those before, in an order that is the same when undone."""
    out = []
    for at in range(0, len(value), SPELLED_CHARS):
        block = value[at : at + SPELLED_CHARS]
        out.append(_spelled_block(block, step, tweak, hexadecimal))
        tweak = blake2b("\0".join([tweak, *sorted([block, out[-1]])]).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return "".join(out)


def _spelled_block(value: str, step: Step, tweak: str, hexadecimal: bool) -> str:
    groups = ["0123456789abcdef"] if hexadecimal else ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    alphabet = [next((g for g in groups if c in g), "") for c in value]
    rank, size = 0, 1
    for c, a in zip(value, alphabet):
        if a:
            rank, size = rank * len(a) + a.index(c), size * len(a)
    if size == 1:
        return value
    layout = "".join("." if not a else a[0] for a in alphabet)
    rank = step(rank, size, f"{tweak}:{layout}")
    out = []
    for c, a in zip(reversed(value), reversed(alphabet)):
        if a:
            rank, at = divmod(rank, len(a))
            c = a[at]
        out.append(c)
    return "".join(reversed(out))


def _refill(layout: str, digits: str) -> str:
    """The layout with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c in DIGITS else c for c in layout)


def luhn_digit(digits: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _is_card(value: str) -> bool:
    digits = re.sub(r"[^0-9]", "", value)
    return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def _card(value: str, step: Step) -> str | None:
    if not _is_card(value):
        return None
    digits = re.sub(r"[^0-9]", "", value)
    body = digits[0] + f"{step(int(digits[1:-1]), 10 ** (len(digits) - 2), f'card:{len(digits)}'):0{len(digits) - 2}d}"
    return _refill(value, body + luhn_digit(body))


def _phone(value: str, step: Step) -> str | None:
    digits = re.sub(r"[^0-9]", "", value)
    if len(digits) == 11 and digits[0] == "1":
        digits = digits[1:]
    if value.startswith("+") and not re.match(r"\+1(?![0-9]{1,2}\b)", value):
        digits = re.sub(r"[^0-9]", "", value)
        if not 8 <= len(digits) <= 15:
            return None
        n = len(digits) - 2
        return _refill(value, digits[:2] + f"{step(int(digits[2:]), 10**n, f'phone:{digits[:2]}:{n}'):0{n}d}")
    if len(digits) != 10:
        return None
    area, exchange, line = int(digits[:3]) - 200, int(digits[3:6]) - 200, int(digits[6:])
    rank = step((area * 800 + exchange) * 10_000 + line, 800 * 800 * 10_000, "phone:1")
    new = f"{rank // 8_000_000 + 200}{rank // 10_000 % 800 + 200}{rank % 10_000:04d}"
    return _refill(value, "1" * (sum(c in DIGITS for c in value) - 10) + new)


def _ssn(value: str, step: Step) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = step(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    area, group, serial = rank // (99 * 9999) + 1, rank // 9999 % 99 + 1, rank % 9999 + 1
    return f"{area + (area >= 666):03d}-{group:02d}-{serial:04d}"


def _number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s))


def _is_iban(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and _number(plain[4:] + plain[:4]) % 97 == 1


def _iban(value: str, step: Step) -> str | None:
    if not _is_iban(value):
        return None
    plain = value.replace(" ", "")
    body = _spelled(plain[4:], step, f"iban:{plain[:2]}")
    new = plain[:2] + f"{98 - _number(body + plain[:2] + '00') % 97:02d}" + body
    left = iter(new)
    return "".join(c if c == " " else next(left) for c in value)


def _ip(value: str, step: Step) -> str | None:
    a, b, c, d = map(int, value.split("."))
    if not 1 <= a <= 254 or not 1 <= d <= 254:
        return None
    rank = step((((a - 1) * 256 + b) * 256 + c) * 254 + d - 1, 254 * 256 * 256 * 254, "ip")
    return f"{rank // (65536 * 254) + 1}.{rank // (256 * 254) % 256}.{rank // 254 % 256}.{rank % 254 + 1}"


def _ipv6(value: str, step: Step) -> str | None:
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return None
    groups = [g for g in value.split(":") if g]
    return _spelled(value, step, "ip6", True) if len(groups) >= IPV6_GROUPS and value == value.lower() else None


_FIRST_DAY = datetime.date(1800, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


def _date(value: str, step: Step) -> str | None:
    parts = re.split(r"[-/.]", value)
    fields = [list(map(int, parts))] if len(parts[0]) == 4 else [[int(parts[2]), int(parts[1]), int(parts[0])], [int(parts[2]), int(parts[0]), int(parts[1])]]
    for which, (year, month, day) in enumerate(fields):
        try:
            rank = datetime.date(year, month, day).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= rank < _DAYS:
            return None
        while True:  # walk on to a date of the same layout
            rank = step(rank, _DAYS, "date")
            new = datetime.date.fromordinal(rank + _FIRST_DAY)
            order = [new.year, new.month, new.day] if len(parts[0]) == 4 else [[new.day, new.month, new.year], [new.month, new.day, new.year]][which]
            if which and new.day <= 12:
                continue
            told = [f"{n:0{len(p)}d}" for n, p in zip(order, parts)]
            if all(len(t) == len(p) for t, p in zip(told, parts)):
                return "".join(t + s for t, s in zip(told, [*re.findall(r"[-/.]", value), ""]))


def _secret(value: str, step: Step) -> str:
    return _spelled(value, step, "secret", bool(re.fullmatch(r"[0-9a-f]+", value)))


_AFTER = r"(?![\w@])"
_RULES: list[tuple[str, re.Pattern, Callable[[str, Step], str | None]]] = [
    ("secret", re.compile(r"\bAKIA([0-9A-Z]{16})\b"), _secret),
    ("secret", re.compile(r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b[\"']?\s?[=:]\s?[\"']?)([^\s\"',;]{6,})"), _secret),
    ("iban", re.compile(r"(?<!\w)([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"), _iban),
    ("ip", re.compile(r"(?<![\w.])((?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]))(?!\w|\.[0-9])"), _ip),
    ("ip", re.compile(r"(?<![\w:.])((?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4})(?![\w:.])"), _ipv6),
    ("date", re.compile(r"(?<![\w/.-])([0-9]{4}-[0-9][0-9]-[0-9][0-9]|[0-9]{4}/[0-9][0-9]/[0-9][0-9]|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-])"), _date),
    ("ssn", re.compile(r"(?<![\w-])([0-9]{3}-[0-9][0-9]-[0-9]{4})(?![\w-])"), _ssn),
    ("phone", re.compile(r"(?<![\w+(])((?:\+?1[ .-]?)?(?:\([2-9][0-9][0-9]\) ?[2-9][0-9][0-9][ .-]?|[2-9][0-9][0-9][ .-][2-9][0-9][0-9][ .-])[0-9]{4})" + _AFTER), _phone),
    ("phone", re.compile(r"(?<![\w+])(\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,9}\)?){2,5})" + _AFTER), _phone),
    ("card", re.compile(r"(?<![\w-])([0-9](?:[ -]?[0-9]){12,18})(?![\w-])"), _card),
    ("card", re.compile(r"(?<![0-9])([0-9]{13,19})(?![0-9])"), _card),
]
_LOCAL = re.compile(r"[\w.%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9-]*+(?:\.[A-Za-z0-9][A-Za-z0-9-]*+)*\.[A-Za-z]{2,24}(?![\w-])")
_WORTH = re.compile(r"[0-9@]")
_NAMED = re.compile(r"(?i)password|passwd|pwd|secret|token|api[_-]?key")


_GROUPED = {_card: _is_card, _iban: _is_iban}
_CARD_GROUPS = re.compile(r"(?:[0-9]{4,}[ -])*[0-9]+")


def _grouped(text: str, kind: str, pattern: re.Pattern, write: Callable[[str, Step], str | None]) -> Iterator[tuple[int, int, str, Callable[[str, Step], str | None]]]:
    """Candidates that pass their check, the longest from each start; those that don't are tried shorter."""
    valid, at, failed, run = _GROUPED[write], 0, [], -1
    while m := pattern.search(text, at):
        start, end = m.span(1)
        first, at = start > run, end  # later starts in what has failed are tried like shorter ends
        failed = [f for f in failed if f[1] > start]  # those that end before this start touch nothing that follows
        ends = [end, *(k for k in range(end - 1, start, -1) if text[k] in " -")]
        for k in ends:
            value = text[start:k]
            if (not first or k < end) and kind == "card" and not _CARD_GROUPS.fullmatch(value):
                continue
            if valid(value):
                near = [(a, b) for a, b in failed if a < k]

                def walked(value: str, step: Step, start: int = start, k: int = k, near: list = near) -> str | None:
                    """A value beside which all that failed before it still fails, so that it is found when undone."""
                    new = write(value, step)
                    while new is not None and any(valid(text[a:start] + new[max(0, a - start) : b - start] + text[k:b]) for a, b in near):
                        new = write(new, step)
                    return new

                yield start, k, kind, walked
                at = k
                break
            failed.append((start, k))
        else:
            run = max(run, end)
            gap = min((k for k in range(start, end) if text[k] in " -"), default=None)
            if gap is not None:
                at = gap + 1


def find(text: str) -> Iterator[tuple[int, int, str, Callable[[str, Step], str | None]]]:
    """Candidates (start, end, kind, how to write it anew), those of higher priority first."""
    at = text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > 0 and _LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                yield start, domain.group().rindex(".") + at + 1, "email", lambda v, step: _spelled(v, step, "email")
        at = text.find("@", at + 1)
    named = bool(_NAMED.search(text))
    for kind, pattern, write in _RULES:
        if write in _GROUPED:
            yield from _grouped(text, kind, pattern, write)
        elif kind != "secret" or named or "AKIA" in text:
            for m in pattern.finditer(text):
                yield *m.span(1), kind, write


def rewrite(text: str, step: Step) -> tuple[str, list[tuple[int, int, str]]]:
    """(the text with pseudonyms, spans (start, end, kind) in it)."""
    if not (_WORTH.search(text) or "AKIA" in text or _NAMED.search(text)):
        return text, []
    taken: list[tuple[int, int, str, str]] = []
    for start, end, kind, write in find(text):
        at = bisect_left(taken, (start,))  # spans taken don't overlap, so only the neighbours can
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            new = write(text[start:end], step)
            if new is not None:
                taken.insert(at, (start, end, kind, new))
    out, spans, at, length = [], [], 0, 0
    for start, end, kind, new in taken:
        out += [text[at:start], new]
        length += start - at
        spans.append((length, length + len(new), kind))
        length += len(new)
        at = end
    return "".join([*out, text[at:]]), spans


@lru_cache(maxsize=8)
def keyed(key: bytes, undo: bool = False) -> Step:
    return lru_cache(maxsize=100_000)(lambda rank, size, tweak: permute(rank, size, key, tweak, undo))


def pseudonymize(df: DataFrame, key: bytes, text_col: str = "text", found: str | None = "pii", undo: bool = False) -> DataFrame:
    """`df` with pseudonyms in its text; `found` names an added column, array of (start, end, kind) in the new text.

    With `undo` the same key gives the original values back."""
    if len(key) < 16:
        raise ValueError("the key needs 16 bytes at least")
    names = [c for c in df.columns if c != found]
    at = names.index(text_col)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = keyed(key, undo)
        for batch in batches:
            for part in slices(batch, column=at):
                done = [(None, []) if t is None else rewrite(t, step) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([t for t, _ in done], part.schema.field(at).type)
                if found:
                    columns.append(pa.array([[dict(zip(("start", "end", "kind"), s)) for s in spans] for _, spans in done], spans_type))
                yield pa.RecordBatch.from_arrays(columns, [*names, *([found] if found else [])])

    kept = df.select(*names)
    schema = kept.select("*", *([F.expr("array(struct(0 AS start, 0 AS end, '' AS kind))").alias(found)] if found else [])).schema
    return kept.mapInArrow(run, schema)
