"""PII: format-preserving pseudonyms from a keyed Feistel permutation.

Numbers and dates are found by pattern and *validated* (Luhn, mod 97, octet
range, calendar, ...); what fails is left as it is.  A valid value is mapped
to its rank among all values of its format, the rank is permuted by a Feistel
network keyed by ``key`` and the kind of value, and the permuted rank is
written back in the same layout: a card stays a Luhn-valid number of equal
length and grouping, a date a calendar date in the same order and padding.
The permutation depends on the value alone, so equal values get equal
pseudonyms in all documents (whatever their grouping; dates in whatever
layout, if both parts are written with two digits and not day-first with
slashes), different ones different pseudonyms, and the holder of the key can
invert it (``restore``).  Mail names and assigned credentials, where people's data
stand in letters, are permuted within the character class of each place.

Kinds: email (name part), credential (``token = "..."``, names in any case),
iban (at its country's length), ip, date (years 1900 to 2099), card, ssn,
phone (all digits but the country code; groups of one digit and up).

Defined results: a null text stays null, a text without a valid value is
unchanged; texts are read whole; every row is treated alike; an empty table
gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import by_row, free_name

#: Stands for the secret that a deployment passes as ``key``.
KEY = b"replace with the deployment's secret"
ROUNDS = 10

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December")
FIRST_DAY = dt.date(1900, 1, 1).toordinal()
DAYS = dt.date(2099, 12, 31).toordinal() - FIRST_DAY + 1

PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<credential>\b(?i:token|secret|password|passwd|api_?key|access_?key)\b[\"']?\s*[=:]\s*[\"'][A-Za-z0-9+/_-]{16,}=*[\"'])"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\w|[./-]\d)"
    rf"|\b\d{{1,2}} (?:{'|'.join(MONTHS)}) \d{{4}}\b|\b(?:{'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}}\b)"
    r"|(?P<card>(?<![\w.-])(?:\d{4}(?P<sep>[ -])\d{4}(?P=sep)\d{4}(?P=sep)\d{4}|\d{4}(?P<gap>[ -])\d{6}(?P=gap)\d{5}|\d{13,19})(?![\w-]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<!\w)\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
    r"|(?<!\w)\+[2-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{1,4}){1,5}(?!\w|[./-]\d)"
    r"|(?<![\w+])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])\d{3}(?P<dash>[.-])\d{3}(?P=dash)\d{4}(?![\w-]|\.\d))")
#: Length of an account number by country (IBAN registry).
IBAN_LENGTHS = {code: int(n) for n, codes in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for code in codes.split(",")}
ANY = re.compile(r"[0-9@=:]")

Permute = Callable[[int, int, str], int]


def feistel(rank: int, size: int, key: bytes, kind: str, inverse: bool = False) -> int:
    """A keyed permutation of range(size): balanced Feistel rounds, walked until inside the range."""
    if size < 2:
        return rank
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    tag = f"{kind}/{size}/".encode()

    def scramble(i: int, x: int) -> int:
        data = tag + bytes([i]) + x.to_bytes((half + 7) // 8, "big")
        out = b"".join(hashlib.blake2b(data + bytes([j]), key=hashlib.blake2b(key).digest()).digest()
                       for j in range(-(-half // 512)))
        return int.from_bytes(out, "big") & mask

    while True:
        left, right = rank >> half, rank & mask
        if inverse:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ scramble(i, left), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ scramble(i, right)
        rank = left << half | right
        if rank < size:
            return rank


def luhn_digit(digits: str) -> str:
    """The check digit to append."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def _fill(layout: str, digits: str) -> str:
    """Put digits in place of the layout's digits."""
    own = iter(digits)
    return "".join(next(own) if c.isdigit() else c for c in layout)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _permute_digits(digits: str, kind: str, permute: Permute) -> str:
    return str(permute(int(digits), 10 ** len(digits), kind)).zfill(len(digits)) if digits else ""


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _by_class(text: str, kind: str, permute: Permute, classes=_CLASSES) -> str:
    """Permute every letter and digit within its class; other characters stay."""
    at = [next((c for c in classes if x in c), "") for x in text]
    rank, size = 0, 1
    for x, c in zip(text, at):
        if c:
            rank, size = rank * len(c) + c.index(x), size * len(c)
    rank = permute(rank, size, kind)
    out = []
    for x, c in zip(reversed(text), reversed(at)):
        if c:
            rank, i = divmod(rank, len(c))
            x = c[i]
        out.append(x)
    return "".join(reversed(out))


def _email(m: str, permute: Permute) -> str:
    name, _, domain = m.partition("@")
    return f"{_by_class(name, f'email@{domain.lower()}', permute)}@{domain}"


def _signs(secret: str) -> tuple[str, ...]:
    """The classes a secret is permuted in: hexadecimal of either case, or letters and digits."""
    for signs in ("0123456789abcdef", "0123456789ABCDEF"):
        if set(secret) <= set(signs):
            return (signs,)
    return _CLASSES


def _credential(m: str, permute: Permute) -> str:
    head, secret, tail = re.fullmatch(r"(.*[=:]\s*[\"'])([A-Za-z0-9+/_-]+)(=*[\"'])", m, re.S).groups()
    signs = _signs(secret)
    while True:                                                # walked until it is read in the same classes
        secret = _by_class(secret, "credential", permute, signs)
        if _signs(secret) == signs:
            return head + secret + tail


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _valid_iban(plain: str) -> bool:
    return 15 <= len(plain) <= 34 and _mod97(plain[4:] + plain[:4]) == 1


def _at_length(m: str) -> str | None:
    """The start of ``m`` of its country's length, if that ends a word and is valid."""
    left, end = IBAN_LENGTHS.get(m[:2], 0), 0
    while left and end < len(m):
        left -= m[end] != " "
        end += 1
    if left or not end or m[end:end + 1] not in ("", " "):
        return None
    return m[:end] if _valid_iban(m[:end].replace(" ", "")) else None


def _iban(m: str, permute: Permute) -> str | None:
    """At its country's length; else the whole, walked until no shorter start is valid."""
    own = _at_length(m)
    value = own or m
    if not own and not _valid_iban(m.replace(" ", "")):
        return None
    while True:
        plain = value.replace(" ", "")
        account = _by_class(plain[4:], f"iban{plain[:2]}", permute, (_CLASSES[0], _CLASSES[2]))
        new = iter(plain[:2] + str(98 - _mod97(account + plain[:2] + "00")).zfill(2) + account)
        value = "".join(c if c == " " else next(new) for c in value)
        if own or _at_length(value) is None:
            return value


def _ip(m: str, permute: Permute) -> str | None:
    parts = m.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    rank = permute(int.from_bytes(bytes(map(int, parts)), "big"), 2 ** 32, "ip")
    return ".".join(map(str, rank.to_bytes(4, "big")))


@lru_cache(maxsize=None)
def _days(order: str, short: str) -> tuple[list[int], dict[int, int]]:
    """Days that a layout can write, and their ranks: ``short`` names the parts of one digit.

    Day-first slash dates are told from month-first ones by a day over 12.
    """
    own = []
    for i in range(DAYS):
        day = dt.date.fromordinal(FIRST_DAY + i)
        if not (("d" in short and day.day > 9) or ("m" in short and day.month > 9) or (order == "d/m" and day.day <= 12)):
            own.append(i)
    return own, {d: r for r, d in enumerate(own)}


def _date(m: str, permute: Permute) -> str | None:
    numbers = re.findall(r"\d+", m)
    named = next((i + 1 for i, name in enumerate(MONTHS) if name in m), 0)
    if named:
        order, parts = ("dmy", (numbers[0], "", numbers[1])) if m[0].isdigit() else ("mdy", ("", numbers[0], numbers[1]))
    elif "-" in m:
        order, parts = "ymd", numbers
    elif "." in m:
        order, parts = "dmy", numbers
    else:
        order, parts = ("d/m" if int(numbers[0]) > 12 else "m/d") + "y", numbers
    letters = order.replace("/", "")
    by = dict(zip(letters, parts))
    try:
        rank = dt.date(int(by["y"]), named or int(by["m"]), int(by["d"])).toordinal() - FIRST_DAY
    except ValueError:
        return None
    short = "".join(x for x in "dm" if len(by[x]) == 1)
    days, ranks = _days(order[:3], short)
    if rank not in ranks:
        return None
    day = dt.date.fromordinal(FIRST_DAY + days[permute(ranks[rank], len(days), f"date{'d/m' if order == 'd/my' else ''}{short}")])
    new = {"y": str(day.year), "d": str(day.day).zfill(len(by["d"])),
           "m": MONTHS[day.month - 1] if named else str(day.month).zfill(len(by["m"]))}
    if named:
        return f"{new['d']} {new['m']} {new['y']}" if order == "dmy" else f"{new['m']} {new['d']}, {new['y']}"
    return ("-" if order == "ymd" else "." if "." in m else "/").join(new[x] for x in letters)


def _card(m: str, permute: Permute) -> str | None:
    digits = _digits(m)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = _permute_digits(digits[:-1], "card", permute)
    return _fill(m, body + luhn_digit(body))


def _ssn(m: str, permute: Permute) -> str | None:
    area, group, serial = map(int, m.split("-"))
    if area in (0, 666) or area >= 900 or group == 0 or serial == 0:
        return None
    rank = permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    rank, serial = divmod(rank, 9999)
    area, group = divmod(rank, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(m: str, permute: Permute) -> str | None:
    """Up to 13 digits after the country code; trailing groups beyond are not its own."""
    code = re.match(r"\+(1|7|\d{1,3}(?=[ .(-])|\d{2})", m)
    keep = code.end() if code else 0
    while len(_digits(m[keep:])) > 13 and (cut := re.search(r"[ .()-]+\d+$", m[keep:])):
        m = m[:keep + cut.start()]
    national = _digits(m[keep:])
    if not 6 <= len(national) <= 13:
        return None
    country = code.group(1) if code else "1"
    return m[:keep] + _fill(m[keep:], _permute_digits(national, f"phone{country}", permute))


KINDS: dict[str, Callable[[str, Permute], str | None]] = {
    "email": _email, "credential": _credential, "iban": _iban, "ip": _ip, "date": _date, "card": _card, "ssn": _ssn,
    "phone": _phone}


def _rewritten(text: str | None, permute: Permute) -> tuple[str | None, int]:
    if not text or not ANY.search(text):
        return text, 0
    done, at, out = 0, 0, []
    while m := PATTERN.search(text, at):
        new = KINDS[m.lastgroup](m.group(), permute)
        end = m.end()
        if new is not None:
            done += 1
            if m.lastgroup in ("iban", "phone"):
                end = m.start() + len(new)                     # what follows the value is read on its own
        out += [text[at:m.start()], m.group() if new is None else new]
        at = end
    return "".join(out) + text[at:], done


def pseudonymise(text: str | None, key: bytes = KEY) -> tuple[str | None, int]:
    """(text with pseudonyms, values replaced)."""
    return _rewritten(text, lambda rank, size, kind: feistel(rank, size, key, kind))


def restore(text: str | None, key: bytes = KEY) -> str | None:
    """Undo ``pseudonymise`` with the same key."""
    return _rewritten(text, lambda rank, size, kind: feistel(rank, size, key, kind, inverse=True))[0]


def pseudonymised(docs: DataFrame, key: bytes = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_replaced) of every row."""
    id_type = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    return by_row(docs, {"id": id_col, "text": text_col}, f"`{id_col}` {id_type}, `{text_col}` string, n_replaced long",
                  lambda _, i, text: (i, *pseudonymise(text, key)))


def pseudonymised_documents(docs: DataFrame, key: bytes = KEY, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the text replaced in place; a length column, if there is one, follows the text."""

    def swap(texts: pd.Series) -> pd.Series:
        return pd.Series([pseudonymise(t, key)[0] for t in texts], dtype=object)

    new = F.pandas_udf(swap, "string")(F.col(f"`{text_col}`"))
    columns = docs.columns
    if length_col not in columns:
        return docs.withColumn(text_col, new)
    swapped = free_name(docs, "_new_text")
    marked = docs.withColumn(swapped, new)
    longer = F.coalesce(F.length(swapped) - F.length(F.col(f"`{text_col}`")), F.lit(0))
    kind = docs.schema[length_col].dataType
    return marked.select(*[F.col(swapped).alias(c) if c == text_col
                           else (F.col(f"`{c}`") + longer).cast(kind).alias(c) if c == length_col
                           else F.col(f"`{c}`") for c in columns])
