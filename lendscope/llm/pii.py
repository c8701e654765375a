"""Format-preserving pseudonyms for personal data (keyed Feistel permutations).

Numbers and dates that pass their own validation (Luhn, mod 97, ranges, calendar) are replaced by another valid value
of the same format; addresses and secrets keep their character classes.  A value is mapped to its rank within its
format, the rank goes through a keyed Feistel network with cycle walking, so the mapping is a permutation of the
format: equal values get equal pseudonyms in every document, different values of a format never meet, and the holder of
the key can invert it.  (One date written with and without leading zeros is two formats.)  Separators do not matter: ``4111-1111 ...`` and ``41111111...`` stay linked.

Map-only: every whole text is read once in Arrow batches, one pattern pass over texts that hold a digit, ``@``, ``=``,
``:`` or the beginning of a key; no shuffle, no state between rows.

Null text stays null, empty text empty; null ``doc_id`` and repeated rows pass through row by row; empty table: no
rows.  Other columns are carried as they are.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, sliced

DEFAULT_KEY = "lendscope pseudonyms"  # a parameter: give a secret key in production
ROUNDS = 8


class Permutation:
    """A keyed permutation of 0..size-1."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        out, n = b"", -(-bits // 8)
        while len(out) < n:
            out += hashlib.blake2b(half.to_bytes(-(-bits // 8), "big") + bytes([i, len(out) // 64]) + tweak,
                                   key=self.key, digest_size=64).digest()
        return int.from_bytes(out[:n], "big") & ((1 << bits) - 1)

    def _walk(self, value: int, size: int, tweak: bytes, order) -> int:
        bits = max(1, -(-(size - 1).bit_length() // 2))
        mask = (1 << bits) - 1
        tweak = tweak + size.to_bytes(-(-size.bit_length() // 8), "big")
        while True:
            a, b = value >> bits, value & mask
            for i in order:
                if order.step > 0:
                    a, b = b, a ^ self._round(tweak, i, b, bits)
                else:
                    a, b = b ^ self._round(tweak, i, a, bits), a
            value = a << bits | b
            if value < size:
                return value

    def forward(self, value: int, size: int, tweak: bytes = b"") -> int:
        return value if size < 2 else self._walk(value, size, tweak, range(ROUNDS))

    def backward(self, value: int, size: int, tweak: bytes = b"") -> int:
        return value if size < 2 else self._walk(value, size, tweak, range(ROUNDS - 1, -1, -1))


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


#: Longer strings are permuted block by block: a rank of a million letters would be a number of a million digits.
BLOCK = 64


def permute_text(text: str, move: Callable[[int, int, bytes], int], kind: bytes, classes=_CLASSES) -> str:
    """Permute a string within its character classes; other characters stay."""
    if len(text) > BLOCK:
        return "".join(permute_text(text[i:i + BLOCK], move, kind + b"@%d" % i, classes) for i in range(0, len(text), BLOCK))
    rank, size, sets = 0, 1, []
    for c in text:
        alphabet = next((a for a in classes if c in a), None)
        sets.append(alphabet)
        if alphabet:
            rank, size = rank * len(alphabet) + alphabet.index(c), size * len(alphabet)
    shape = "".join("-" if a is None else str(classes.index(a)) for a in sets)
    rank, out = move(rank, size, kind + shape.encode()), list(text)
    for i in range(len(text) - 1, -1, -1):
        if sets[i]:
            rank, r = divmod(rank, len(sets[i]))
            out[i] = sets[i][r]
    return "".join(out)


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """The check digit of ``digits``."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def card(text: str, move) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    size = 10 ** (len(digits) - 2)  # the first digit names the network and stays
    body = digits[0] + str(move(int(digits[1:-1]), size, b"card" + digits[0].encode())).zfill(len(digits) - 2)
    return _refill(text, body + str(luhn(body)))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(text: str, move) -> str | None:
    flat = text.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
        return None
    body = permute_text(flat[4:], move, b"iban" + flat[:2].encode())
    check = 98 - _mod97(body + flat[:2] + "00")
    it = iter(f"{flat[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


def ssn(text: str, move) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    return _walked(text, move, b"ssn", valid)


def phone(text: str, move) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 10 <= len(digits) <= 15:
        return None
    if text.lstrip().startswith("+") and not (digits[0] == "1" and len(digits) == 11):
        if len(digits) < 11:
            return None
        head = digits[:2]  # at least the first two digits of the country code stay
        return _refill(text, head + str(move(int(digits[2:]), 10 ** (len(digits) - 2), b"tel" + head.encode()))
                       .zfill(len(digits) - 2))
    head = digits[:-10]
    if head not in ("", "1"):
        return None

    def valid(d: str) -> bool:
        return d[0] in "23456789" and d[3] in "23456789"

    new = _walked(digits[-10:], move, b"nanp", valid)
    if new is None and (head or "(" in text):  # written as a phone number, whatever its area code
        new = str(move(int(digits[-10:]), 10 ** 10, b"tel")).zfill(10)
    return None if new is None else _refill(text, head + new)


def _walked(text: str, move, kind: bytes, valid: Callable[[str], bool]) -> str | None:
    """Permute the digits of ``text`` among the valid ones of that length (cycle walking)."""
    digits = re.sub(r"\D", "", text)
    if not valid(digits):
        return None
    while True:
        digits = str(move(int(digits), 10 ** len(digits), kind)).zfill(len(digits))
        if valid(digits):
            return _refill(text, digits)


def address(text: str, move) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = move(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ipv4")
    return ".".join(map(str, value.to_bytes(4, "big")))


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(text: str, move) -> str | None:
    """A date of the same format: order of its parts, separator, and one or two digits for day and month.

    ``a/b/yyyy`` is day first where that is a date, else month first; the latter (its day is over 12) has a
    permutation of its own, so that no pseudonym can be read the other way."""
    sep = re.search(r"\D", text)[0]
    parts = text.split(sep)
    if len(parts[0]) == 4:
        orders = [(0, 1, 2)]
    elif sep == ".":
        orders = [(2, 1, 0)]
    else:
        orders = [(2, 1, 0), (2, 0, 1)]
    for y, m, d in orders:
        try:
            n = datetime.date(int(parts[y]), int(parts[m]), int(parts[d])).toordinal()
        except ValueError:
            continue
        if not _FIRST <= n <= _LAST:
            continue
        short, swapped = (len(parts[d]) == 1, len(parts[m]) == 1), d == 1
        kind = b"date" + b"%d%d%d" % (*short, swapped) * any((*short, swapped))
        while True:  # cycle walking among the dates of that format
            n = _FIRST + move(n - _FIRST, _LAST - _FIRST + 1, kind)
            new = datetime.date.fromordinal(n)
            if (new.day < 10 or not short[0]) and (new.month < 10 or not short[1]) and (new.day > 12 or not swapped):
                break
        out = list(parts)
        out[y] = f"{new.year:04d}"
        out[m], out[d] = f"{new.month:0{len(parts[m])}d}", f"{new.day:0{len(parts[d])}d}"
        return sep.join(out)
    return None


def email(text: str, move) -> str | None:
    name, host = text.rsplit("@", 1)
    labels, top = host.rsplit(".", 1)
    return f"{permute_text(name, move, b'name')}@{permute_text(labels, move, b'host')}.{top}"


def secret(text: str, move) -> str | None:
    if re.fullmatch(r"[0-9a-f]+", text):
        return permute_text(text, move, b"hex", ("0123456789abcdef",))
    return permute_text(text, move, b"secret")


#: Kind, pattern of the value (the named group is what is replaced), rule.
RULES: tuple[tuple[str, str, Callable], ...] = (
    # a name has at most 64 characters: without a bound every letter of a long word would be read to its end
    ("email", r"(?P<email>[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9](?:[\w-]*\.)+[A-Za-z]{2,})", email),
    ("secret", r"(?i:(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)"
               r"(?P<secret>[A-Za-z0-9_+/.-]{8,})", secret),
    ("key", r"\b(?P<key>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,})\b", secret),
    ("iban", r"\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b", iban),
    ("ssn", r"(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])", ssn),
    ("date", r"(?<![\d./-])(?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])", date),
    ("ip", r"(?<![\d.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)", address),
    ("phone", r"(?P<phone>\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
              r"|\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"
              r"|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))", phone),
    # a run of digits, or groups with one kind of separator: never two numbers that stand side by side
    ("card", r"(?<![\d-])(?P<card>\d{13,19}(?!\d)|\d{4}(?: \d{4}){2} \d{1,7}(?!\d)|\d{4}(?:-\d{4}){2}-\d{1,7}(?!\d)"
             r"|\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d))", card),
)
_PATTERN = re.compile("|".join(p for _, p, _ in RULES))
_RULE = {k: f for k, _, f in RULES}
#: Every alternative of ``_PATTERN`` needs one of these: a digit of any script, a separator, or the beginning of a key.
_MAYBE = re.compile(r"[\d@=:]|AKIA|ASIA|gh[pousr]_|sk-")


def pseudonymize_text(text: str, move: Callable[[int, int, bytes], int]) -> tuple[str, list[str]]:
    """The text with every valid value replaced, and the kinds found in order."""
    if not _MAYBE.search(text):
        return text, []
    out, at, kinds = [], 0, []
    pos = 0
    while m := _PATTERN.search(text, pos):
        kind = m.lastgroup
        value = m[kind]
        new = _RULE[kind](value, move)
        while new is None and kind == "iban" and " " in value:  # it may have taken the next word along
            value = value.rsplit(" ", 1)[0]
            new = _RULE[kind](value, move)
        if new is None:  # not valid: look again behind its first character
            pos = m.start() + 1
            while pos < m.end() and text[pos - 1].isdigit() and text[pos].isdigit() and kind != "iban":
                pos += 1  # never inside a run of digits
            continue
        a = m.start(kind)
        b = a + len(value)
        out += [text[at:a], new]
        at = pos = b
        kinds.append(kind)
    return "".join(out) + text[at:], kinds


def pseudonymize(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """All columns of ``docs`` with ``text`` pseudonymized, plus ``pii_found long`` and ``pii_kinds string``."""
    ready(docs.sparkSession)
    secret_key = hashlib.blake2b(key.encode(), digest_size=32).digest()
    others = [c for c in docs.columns if c not in ("text", "pii_found", "pii_kinds")]
    base = docs.select(*[F.col(f"`{c}`") for c in others], F.col("text").cast("string").alias("text"))
    schema = base.withColumns({"pii_found": F.lit(0).cast("long"), "pii_kinds": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move = Permutation(secret_key).forward
        for batch in (part for whole in batches for part in sliced(whole)):
            texts, kinds = [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                new, found = (t, []) if t is None else pseudonymize_text(t, move)
                texts.append(new)
                kinds.append(found)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, kinds), pa.int64()),
                 pa.array([",".join(sorted(set(k))) for k in kinds], pa.string())], names=schema.names)

    return base.mapInArrow(run, schema)
