"""Format-preserving pseudonyms: what is recognised and valid is permuted, under a key, among the values of its own format."""

from __future__ import annotations

import bisect
import calendar
import datetime
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from corestrata.llm.common import batches, pair

KINDS = ("email", "card", "ip", "phone", "ssn", "date", "iban")
ROUNDS = 10
#: A fixed key for tests and the registered query; production passes its own secret.
DEMO_KEY = b"corestrata demonstration key"
_YEARS = range(1900, 2100)
#: Days of the month above 12, in order: a date is permuted among those on the same side of 12, so that day and month stay as easy or hard to tell apart as they were.
_LATE = [datetime.date(y, m, d).toordinal() for y in _YEARS for m in range(1, 13) for d in range(13, calendar.monthrange(y, m)[1] + 1)]
#: Lengths of bank account numbers by country (ISO 13616 registry), and calling codes of two digits (ITU E.164; 1 and 7 are alone, all others have three).
IBAN_LENGTH = {c: int(n) for c, n in (x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 "
    "LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20").split())}  # fmt: skip
_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Where something may begin: an address, or two letters and two digits, or a digit with what may stand before it.
_START = re.compile(r"(?P<email>(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-]))|(?<!\w)(?=[A-Z]{2}[0-9]{2}[ 0-9A-Z]|\+?\(?[0-9])", re.ASCII)
#: Forms in the order in which they are tried at one place. Grouped cards come before runs of digits.
_FORMS = tuple((k, re.compile(p, re.ASCII)) for k, p in (
    ("card", r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?!\w)"),
    ("card", r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{3}(?!\w)"),
    ("card", r"[0-9]{4}([ -])[0-9]{6}\1[0-9]{4,5}(?!\w)"),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"),
    ("date", r"(?<![\w/.-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?!(?!T[0-9])\w|[-/.][0-9])"),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w|-[0-9])"),
    ("phone", r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-][0-9]{3}[ .-]?[0-9]{4}(?!\w)"),
    ("phone", r"(?<![\w+])\+[0-9]{8,15}(?!\w)"),
    ("card", r"[0-9]{13,19}(?!\w)"),
))
_ABROAD = re.compile(r"(?<![\w+])\+[0-9]{1,3}(?:[ .-]\(?[0-9]{1,8}\)?){2,6}", re.ASCII)
_WORD = re.compile(r"\w", re.ASCII)
_MAYBE = re.compile(r"[0-9][0-9 ().+/-]{3}|@|[0-9]/[0-9]{1,2}/[0-9]")


def permute(n: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 <= n < size: a Feistel network over the next even number of bits, walked until it falls inside."""
    if size < 2:
        return n
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1

    def turn(i: int, x: int) -> int:
        raw = hashlib.blake2b(f"{tweak}/{size}/{i}/{x}".encode(), key=hashlib.sha256(key).digest(), digest_size=max(16, half // 8 + 1)).digest()
        return int.from_bytes(raw, "big") & mask

    while True:
        a, b = n >> half, n & mask
        if back:
            for i in reversed(range(ROUNDS)):
                a, b = b ^ turn(i, a), a
        else:
            for i in range(ROUNDS):
                a, b = b, a ^ turn(i, b)
        n = a << half | b
        if n < size:
            return n


def _alphabet(c: str) -> str:
    return "0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "abcdefghijklmnopqrstuvwxyz"


def permute_text(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Letters and digits permuted together, each within its class; other characters stay where they are."""
    spots = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    sets = [_alphabet(text[i]) for i in spots]
    n, size = 0, 1
    for i, s in zip(spots, sets, strict=True):
        n, size = n * len(s) + s.index(text[i]), size * len(s)
    shape = "".join({10: "9", 26: "A" if s[0] == "A" else "a"}[len(s)] for s in sets)
    n = permute(n, size, key, f"{tweak}/{shape}", back)
    out = list(text)
    for i, s in zip(reversed(spots), reversed(sets), strict=True):
        n, k = divmod(n, len(s))
        out[i] = s[k]
    return "".join(out)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _luhn_digit(body: str) -> str:
    return next(d for d in "0123456789" if luhn(body + d))


def _digits_into(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _iban_rest(body: str, country: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{body}{country}00')) % 97:02d}"


def _date_parts(value: str) -> tuple[datetime.date, str] | None:
    sep = next(c for c in value if not c.isdigit())
    parts = [int(x) for x in value.split(sep)]
    for form, (y, m, d) in (("ymd", parts), ("dmy", parts[::-1]), ("mdy", [parts[2], parts[0], parts[1]])):
        if (len(value.split(sep)[0]) == 4) == (form == "ymd"):
            try:
                day = datetime.date(y, m, d)
            except ValueError:
                continue
            if y in _YEARS:
                return day, form
    return None


def _other_day(day: datetime.date, key: bytes, back: bool) -> datetime.date:
    """The same for one day in every format: that is what links them."""
    if day.day > 12:
        return datetime.date.fromordinal(_LATE[permute(bisect.bisect_left(_LATE, day.toordinal()), len(_LATE), key, "date/late", back)])
    n = permute(((day.year - _YEARS[0]) * 12 + day.month - 1) * 12 + day.day - 1, len(_YEARS) * 144, key, "date/early", back)
    return datetime.date(_YEARS[0] + n // 144, n // 12 % 12 + 1, n % 12 + 1)


def _calling_code(digits: str) -> int:
    """Digits of the country's code in front."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in _CODES else 3


@functools.lru_cache(100_000)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The value's pseudonym, valid in the same format; None for a value that isn't valid. back: from the pseudonym to the value."""
    digits = "".join(c for c in value if c.isdigit())
    if kind == "email":
        name, _, host = value.rpartition("@")
        inner, dot, top = host.rpartition(".")
        return f"{permute_text(name, key, 'email', back)}@{permute_text(inner, key, 'host', back)}{dot}{top}"
    if kind == "card":
        if not (13 <= len(digits) <= 19 and luhn(digits)):
            return None
        body = permute_text(digits[:-1], key, "card", back)
        return _digits_into(value, body + _luhn_digit(body))
    if kind == "ip":
        parts = [int(x) for x in value.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None
        return ".".join(map(str, permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", back).to_bytes(4, "big")))
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        n = permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn", back)
        area, n = divmod(n, 99 * 9999)
        area += 1 + (area >= 665)
        return f"{area:03d}-{n // 9999 + 1:02d}-{n % 9999 + 1:04d}"
    if kind == "phone":
        keep = _calling_code(digits) if value[0] == "+" else 0
        return _digits_into(value, digits[:keep] + permute_text(digits[keep:], key, "phone", back))
    if kind == "date":
        if not (found := _date_parts(value)):
            return None
        day, form = _other_day(found[0], key, back), found[1]
        sep = next(c for c in value if not c.isdigit())
        short = any(len(x) == 1 for x in value.split(sep))
        y, m, d = f"{day.year:04d}", *(str(x) if short else f"{x:02d}" for x in (day.month, day.day))
        return sep.join({"ymd": (y, m, d), "dmy": (d, m, y), "mdy": (m, d, y)}[form])
    flat = value.replace(" ", "")
    if IBAN_LENGTH.get(flat[:2]) != len(flat) or _iban_rest(flat[4:], flat[:2]) != flat[2:4]:
        return None
    body = permute_text(flat[4:], key, "iban", back)
    it = iter(flat[:2] + _iban_rest(body, flat[:2]) + body)
    return "".join(c if c == " " else next(it) for c in value)


def _iban_end(text: str, at: int) -> int | None:
    """Where an account number of its country's length ends that begins at a place: unbroken, or in groups of four with one blank between."""
    n = IBAN_LENGTH.get(text[at : at + 2], 0)
    for end, blanks in ((at + n, ""), (at + n + (n - 1) // 4, " ")):
        part = text[at:end]
        flat = part.replace(blanks, "") if blanks else part
        if n and len(flat) == n and flat.isascii() and flat.isalnum() and flat.upper() == flat and (not blanks or part == " ".join(flat[i : i + 4] for i in range(0, n, 4))) and not _WORD.match(text, end):
            return end
    return None


def candidates(text: str, at: int):
    """(kind, end) of what may be an identifier that begins at a place, in the order of preference; which are valid, pseudonym() says."""
    if (end := _iban_end(text, at)) is not None:
        yield "iban", end
    for kind, form in _FORMS:
        if m := form.match(text, at):
            yield kind, m.end()
    if m := _ABROAD.match(text, at):  # from the longest end on
        for end in range(m.end(), at, -1):
            part = text[at:end]
            if part[-1] in "0123456789)" and not _WORD.match(text, end) and 8 <= sum(map(str.isdigit, part)) <= 15 and part.count("(") == part.count(")"):
                yield "phone", end


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what they replaced, in code points of the original. From left to right; at one place the first candidate that is valid."""
    if not _MAYBE.search(text):
        return text, []
    parts, spans, at, look = [], [], 0, 0
    while m := _START.search(text, look):
        start = m.start()
        for kind, end in [("email", m.end())] if m["email"] else candidates(text, start):
            if (new := pseudonym(kind, text[start:end], key, back)) is not None:
                parts += [text[at:start], new]
                spans.append((kind, start, end))
                at = look = end
                break
        else:
            look = start + 1
    return "".join([*parts, text[at:]]), spans


_OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def _replace(key: bytes, back: bool):
    def run(source):
        def make(batch):
            done = [(None, []) if t is None else pseudonymise(t, key, back) for t in batch.column(1).to_pylist()]
            return [batch.column(0), [t for t, _ in done], [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done]]

        yield from batches(source, make, _OUT)

    return run


def pseudonymise_documents(docs: DataFrame, key: bytes, back: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with pseudonyms), spans. Under one key equal values get equal pseudonyms in all documents; back undoes them.

    Recognised: e-mail addresses; card numbers of 13 to 19 digits whose check digit is right, in the usual groups
    or unbroken; IPv4 addresses; phone numbers of ten digits in groups, and international ones after a plus sign,
    unbroken or in groups (all that follow, up to 15 digits); US social security numbers; calendar dates from 1900
    to 2099, by year, day or month first, of which one day has one pseudonym in all formats (01/05/2024 is read as
    the first of May); account numbers (IBAN) of their country's length whose check digits are right. What looks
    alike but isn't valid stays. Of several that begin at one place the order is that of candidates(); what begins
    earlier goes first, and spans don't overlap. back undoes all but the padding of dates with parts of one digit.

    Null texts stay null and empty ones empty; whole texts of any length are scanned; null doc_ids stay null;
    repeated rows each give a row; an empty table gives none. Further columns are not read, whatever they are
    called. No shuffle.
    """
    return pair(docs, id_col, text_col).selectExpr("cast(_id as long)", "_value").mapInArrow(_replace(key, back), "doc_id long, text string, spans array<struct<kind:string,start:long,end:long>>")
