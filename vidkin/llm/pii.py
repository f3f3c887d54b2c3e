"""Format-preserving pseudonyms for personal numbers and dates by a keyed Feistel permutation.

Found values are validated (card: Luhn; account: the check digits of an IBAN; phone: 10 to 15 digits; address:
four octets; date: a calendar day of 1900 to 2099, with slashes the month first, or the day where that is no
date; social: issuable areas) and permuted within the set of values of their format, so separators, length,
check digits and validity stay, and equal values get equal pseudonyms in every document, however they are
written. Days up to the 12th stay such days, so that a date is read the same way again. Local parts of e-mail
addresses are permuted character class by character class. The permutation is a bijection of the format's set
and can be undone with the key, which has no default. Where a run of digits isn't valid as a whole, its
beginnings up to a separator (for cards from the usual first digits) and then the other kinds are tried, then
what begins later; such parts of runs may be read otherwise when undoing.

Defined results: null text stays null and counts 0; numbers that aren't valid stay; repeated rows are
treated alike; an empty table gives an empty result; other columns are ignored (their names don't
clash, as only doc_id and text are read). Texts are processed whole.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .store import bound_batches

KINDS = ("email", "address", "date", "social", "account", "card", "phone")
ROUNDS = 8
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)",
    "address": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)",
    "date": r"(?<!\d)(?:\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4})(?!\d)",
    "social": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{6,8})(?!\d)",
}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()))
_ONE = {k: re.compile(p) for k, p in _PATTERNS.items()}


class Feistel:
    """A keyed permutation of 0..n-1 for any n, with a tweak: rounds of modular addition on a times b >= n,
    walked along its cycle until the value lies in range."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, tweak: str, n: int, r: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{n}|{r}|{x}".encode(), key=self.key, digest_size=16).digest(), "big")

    def _step(self, x: int, n: int, tweak: str, back: bool) -> int:
        a = math.isqrt(n - 1) + 1 if n > 1 else 1
        left, right = divmod(x, a)
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if back:
                left, right = (right - self._f(tweak, n, r, left)) % a, left
            else:
                left, right = right, (left + self._f(tweak, n, r, right)) % a
        return left * a + right

    def apply(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        while True:
            x = self._step(x, n, tweak, back)
            if x < n:
                return x


def luhn(digits: str) -> int:
    """The check digit that makes digits + it valid."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        self.f, self.back = Feistel(key), back
        self.value = lru_cache(100_000)(self._value)

    def _perm(self, x: int, n: int, tweak: str) -> int:
        return self.f.apply(x, n, tweak, self.back)

    def _value(self, kind: str, found: str) -> str | None:
        """The pseudonym, or None where the value isn't valid."""
        digits = "".join(c for c in found if c.isdigit())
        if not found.isascii():
            return None
        if kind == "email":
            n, x, radix = 1, 0, {"d": 10, "a": 26, "A": 26}
            kinds = ["d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "" for c in found]
            for c, k in zip(found, kinds, strict=True):
                if k:
                    n, x = n * radix[k], x * radix[k] + (ord(c) - ord("0" if k == "d" else k))
            y, out = self._perm(x, n, "email:" + "".join(kinds)), []
            for c, k in zip(reversed(found), reversed(kinds), strict=True):
                if k:
                    y, d = divmod(y, radix[k])
                    c = chr(ord("0" if k == "d" else k) + d)
                out.append(c)
            return "".join(reversed(out)) if n > 1 else None
        if kind == "address":
            octets = [int(o) for o in found.split(".")]
            if max(octets) > 255:
                return None
            y = self._perm(int.from_bytes(bytes(octets), "big"), 2**32, kind)
            return ".".join(map(str, y.to_bytes(4, "big")))
        if kind == "date":
            iso = found[4] == "-"
            y, m, d = (int(digits[:4]), int(digits[4:6]), int(digits[6:])) if iso else (int(digits[4:]), int(digits[2:4]), int(digits[:2]))
            month_first = not iso and found[2] == "/" and d <= 12
            if month_first:
                m, d = d, m
            try:
                x = datetime.date(y, m, d).toordinal() - _FIRST_DAY
            except ValueError:
                return None
            if not 0 <= x < _DAYS:
                return None
            while True:
                x = self._perm(x, _DAYS, kind)
                new = datetime.date.fromordinal(_FIRST_DAY + x)
                if (new.day <= 12) == (d <= 12):
                    break
            return new.isoformat() if iso else new.strftime("%m/%d/%Y" if month_first else f"%d{found[2]}%m{found[5]}%Y")
        if kind == "account":
            return self._account(found)
        if kind == "social":
            x = int(digits)
            if not self._issuable(x):
                return None
            while True:
                x = self._perm(x, 10**9, kind)
                if self._issuable(x):
                    return _refill(found, f"{x:09d}")
        if kind == "card":
            if luhn(digits[:-1]) != int(digits[-1]):
                return None
            n = len(digits) - 1
            new = f"{self._perm(int(digits[:-1]), 10**n, f'card:{n}'):0{n}d}"
            return _refill(found, new + str(luhn(new)))
        if not 10 <= len(digits) <= 15:
            return None
        keep = len(digits) - 10
        return _refill(found, digits[:keep] + f"{self._perm(int(digits[keep:]), 10**10, f'phone:{digits[:keep]}'):010d}")

    def _account(self, found: str) -> str | None:
        """Digits of the account are permuted, letters stay, check digits are made anew."""
        plain = found.replace(" ", "")
        check = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
        if check(plain) != 1:
            return None
        own = "".join(c for c in plain[4:] if c.isdigit())
        if not own:
            return None
        shape = plain[:2] + "".join("d" if c.isdigit() else c for c in plain[4:])
        body = _refill(plain[4:], f"{self._perm(int(own), 10 ** len(own), f'account:{shape}'):0{len(own)}d}")
        new = iter(plain[:2] + f"{98 - check(plain[:2] + '00' + body):02d}" + body)
        return "".join(" " if c == " " else next(new) for c in found)

    @staticmethod
    def _issuable(x: int) -> bool:
        area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    def _at(self, m: re.Match) -> tuple[str, int, str] | None:
        """kind, end and pseudonym of the first valid reading of what was found at m's place."""
        kinds = list(KINDS)
        for kind in kinds[kinds.index(m.lastgroup) :]:
            found = m[0] if kind == m.lastgroup else (x := _ONE[kind].match(m.string, m.start())) and x[0]
            while found:
                new = self.value(kind, found)
                if new is not None:
                    return kind, m.start() + len(found), new
                # A shorter reading ends before a separator and has digits enough.
                found = found[: max(found.rfind(" "), found.rfind("-"))] if kind in ("card", "account") and re.search("[ -]", found) else ""
                if found and (not _ONE[kind].fullmatch(found) or kind == "card" and found[0] not in "23456"):
                    break
        return None

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        counts, out, at, look = dict.fromkeys(KINDS, 0), [], 0, 0
        while m := _FIND.search(text, look):
            got = self._at(m)
            if got is None:
                # What comes next may begin inside, after a separator; an e-mail's part is read once only.
                look = m.end() if m.lastgroup == "email" else m.start() + 1
                continue
            kind, look, new = got
            counts[kind] += 1
            out += [text[at : m.start()], new]
            at = look
        return "".join(out) + text[at:], counts


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, and n_<kind> for each kind. back=True undoes it with the same key."""
    if not key:
        raise ValueError("a key is needed")
    bound_batches(docs.sparkSession)
    names = ["doc_id", "text", *[f"n_{k}" for k in KINDS]]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Pseudonyms(key, back)
        for batch in batches:
            done = [own.text(t) if t is not None else (None, dict.fromkeys(KINDS, 0)) for t in batch.column(1).to_pylist()]
            counts = [pa.array([c[k] for _, c in done], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), *counts], names)

    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS))
