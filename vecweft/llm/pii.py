"""Operator 7: format-preserving pseudonyms by keyed Feistel permutations."""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import secrets
import string
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import pieces_of

#: The session's setting that holds the key of the query and the pipeline, in hexadecimal digits.
KEY_SETTING = "spark.vecweft.pii.key"
ROUNDS = 8
#: Characters of a value that are permuted together.
CHARS = 64
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Country calling codes of one and two digits; all others have three.
CALLING_CODES = {
    1: "1 7".split(),
    2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split(),
}

# Each alternative can begin only where a run of its characters begins, or is of bounded length, and runs are not given back: a
# search is linear in the text.
_PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+-])[\w.+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,})
    |(?P<secret>(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b)["']?\s*[=:]\s*["']?(?P<value>[A-Za-z0-9+/_.~-]{6,}))
    |(?P<aws>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)
    |(?P<hex>\b(?=[0-9a-f]*\d)(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})\b)
    |(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
    |(?P<date>(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d))
    |(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))
    |(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
    |(?P<card>(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d]))
    |(?P<phone>(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)
        |(?<![\w.])(?<!\d[ -])(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w]|[ -]\d)
        |(?<![\w.])\+\d{8,15}(?!\w))""",
    re.VERBOSE,
)
_ANY = re.compile(r"[0-9@]|AKIA|ASIA|(?i:passw|pwd|token|secret|api.?key|access.?key)")

DIGITS, LOWER, UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
HEX = DIGITS + "abcdef"


class Permuter:
    """Keyed permutations of 0..n-1: a balanced Feistel network over the next even number of bits, walked along its
    cycle until the value lies below n again. Names keep the permutations of different kinds apart."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _rounds(self, n: int, name: str):
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        size, tweak = (half + 7) // 8, f"{name}/{n}/".encode()

        def mixed(i: int, side: int) -> int:
            digest = hashlib.blake2b(tweak + bytes([i]) + side.to_bytes(size, "big"), key=self.key, digest_size=min(64, size + 8)).digest()
            return int.from_bytes(digest, "big") & (1 << half) - 1

        return half, mixed

    def __call__(self, value: int, n: int, name: str) -> int:
        if n < 2:
            return value
        half, mixed = self._rounds(n, name)
        while True:
            left, right = value >> half, value & (1 << half) - 1
            for i in range(ROUNDS):
                left, right = right, left ^ mixed(i, right)
            value = left << half | right
            if value < n:
                return value

    def inverse(self, value: int, n: int, name: str) -> int:
        if n < 2:
            return value
        half, mixed = self._rounds(n, name)
        while True:
            left, right = value >> half, value & (1 << half) - 1
            for i in reversed(range(ROUNDS)):
                left, right = right ^ mixed(i, left), left
            value = left << half | right
            if value < n:
                return value

    def text(self, text: str, name: str, alphabets: tuple[str, ...] | None = None) -> str:
        """Each character of an alphabet becomes one of the same alphabet; others stay. Equal shapes, that is equal alphabets place by
        place, share a permutation. The default alphabets are digits and letters: see ``alphabet``. Long texts are permuted in blocks,
        each by what the blocks before it have become."""
        if len(text) > CHARS:
            head = self.text(text[:CHARS], name, alphabets)
            out = [head]
            for at in range(CHARS, len(text), CHARS):
                out.append(self.text(text[at : at + CHARS], f"{name}/{at}/{out[-1]}", alphabets))
            return "".join(out)
        if alphabets is None:
            places = [(i, a) for i, c in enumerate(text) if (a := alphabet(c))]
        else:
            places = [(i, a) for i, c in enumerate(text) for a in alphabets if c in a]
        value, n = 0, 1
        for i, a in places:
            value, n = value * len(a) + a.index(text[i]), n * len(a)
        value, out = self(value, n, name), list(text)
        for i, a in reversed(places):
            value, at = divmod(value, len(a))
            out[i] = a[at]
        return "".join(out)


@functools.cache
def alphabet(character: str) -> str:
    """What a character may become: ASCII digits, lower-case or upper-case letters, or else the letters and digits of the same
    Unicode category among the 256 code points around. Empty for a character that stays."""
    for plain in (DIGITS, LOWER, UPPER):
        if character in plain:
            return plain
    if not character.isalnum() or character.isascii():
        return ""
    kind, first = unicodedata.category(character), ord(character) & ~255
    return "".join(c for c in map(chr, range(max(first, 128), first + 256)) if c.isalnum() and unicodedata.category(c) == kind)


def luhn(payload: str) -> str:
    """The check digit that follows."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    digits = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(digits) % 97:02d}"


def _in_place(text: str, chars: str) -> str:
    """``text`` with its letters and digits replaced in turn."""
    new = iter(chars)
    return "".join(next(new) if c.isalnum() else c for c in text)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.permute = Permuter(key)

    def _date(self, text: str) -> str | None:
        parts = re.split(r"[-/.]", text)
        try:
            if "-" in text:
                day, order = datetime.date(*map(int, parts)), "ymd"
            else:
                a, b, y = map(int, parts)
                order = "mdy" if "/" in text and a <= 12 else "dmy"
                day = datetime.date(y, a, b) if order == "mdy" else datetime.date(y, b, a)
        except ValueError:
            return None
        if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + self.permute(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
        if order == "ymd":
            return new.isoformat()
        a, b = (new.month, new.day) if order == "mdy" else (new.day, new.month)
        wide = len(parts[0]) == len(parts[1]) == 2
        sign = "/" if "/" in text else "."
        return f"{a:02d}{sign}{b:02d}{sign}{new.year}" if wide else f"{a}{sign}{b}{sign}{new.year}"

    def replace(self, match: re.Match) -> tuple[str, str] | None:
        """(kind, pseudonym), or None where the value is not valid."""
        kind, text = match.lastgroup if match.lastgroup != "value" else "secret", match[0]
        p = self.permute
        if kind == "email":
            local, _, domain = text.rpartition("@")
            if not any(map(str.isalnum, local)):
                return None
            return kind, p.text(local, "email/" + domain.lower()) + "@" + domain
        if kind == "secret":
            value, at = match["value"], match.start("value") - match.start()
            return kind, text[:at] + self._secret(value) + text[at + len(value) :]
        if kind == "aws":
            return kind, text[:4] + p.text(text[4:], "aws", (DIGITS + UPPER,))
        if kind == "hex":
            return kind, self._secret(text)
        if kind == "date":
            new = self._date(text)
            return new and (kind, new)
        if kind == "ip":
            octets = text.split(".")
            if any(int(x) > 255 or x != str(int(x)) for x in octets):
                return None
            value, n, first = 0, 1, {1: 0, 2: 10, 3: 100}
            sizes = [{1: 10, 2: 90, 3: 156}[len(x)] for x in octets]
            for x, size in zip(octets, sizes, strict=True):
                value, n = value * size + int(x) - first[len(x)], n * size
            value, out = p(value, n, "ip"), []
            for x, size in zip(reversed(octets), reversed(sizes), strict=True):
                value, at = divmod(value, size)
                out.append(str(at + first[len(x)]))
            return kind, ".".join(reversed(out))
        plain = "".join(c for c in text if c.isalnum())
        if kind == "iban":
            if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
                return None
            account = p.text(plain[4:], "iban/" + plain[:2], (DIGITS, UPPER))
            return kind, _in_place(text, plain[:2] + iban_check(plain[:2], account) + account)
        if kind == "card":
            # Digits of another number may follow: the longest run of whole groups that is valid counts.
            for end in [len(text), *(m.start() for m in reversed(list(re.finditer("[ -]", text))))]:
                plain = "".join(c for c in text[:end] if c.isdigit())
                if len(plain) >= 13 and luhn(plain[:-1]) == plain[-1]:
                    payload = p.text(plain[:-1], "card", (DIGITS,))
                    return kind, _in_place(text[:end], payload + luhn(payload)) + text[end:]
            return None
        if kind == "ssn":
            area, group, serial = map(int, text.split("-"))
            if area in (0, 666) or area >= 900 or not group or not serial:
                return None
            areas = [a for a in range(1, 900) if a != 666]
            value = p((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, "ssn")
            value, serial = divmod(value, 9999)
            area, group = divmod(value, 99)
            return kind, f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"
        if not 7 <= len(plain) <= 15:
            return None
        code = next((c for n in (1, 2) if (c := plain[:n]) in CALLING_CODES[n]), plain[:3]) if text[0] == "+" else ""
        return kind, _in_place(text, code + self._number(plain[len(code) :]))

    def _number(self, digits: str) -> str:
        """A phone number without its country's code. Zeros at its begin (trunk prefixes) stay, and no other begins with one."""
        rest = digits.lstrip("0")
        low = 10 ** (len(rest) - 1) if rest else 0
        return digits[: len(digits) - len(rest)] + (str(low + self.permute(int(rest) - low, 9 * low, "phone")) if rest else "")

    def _secret(self, value: str) -> str:
        """Lower-case hexadecimal strings become such, and others never do, so that each shape's images are its own."""
        if set(value) <= set(HEX):
            return self.permute.text(value, "secret/hex", (HEX,))
        while True:
            value = self.permute.text(value, "secret")
            if not set(value) <= set(HEX):
                return value

    def rewrite(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in code points."""
        if not _ANY.search(text):
            return text, []
        out, at, spans, size = [], 0, [], 0
        start = 0
        while match := _PATTERN.search(text, start):
            found = self.replace(match)
            if found is None and match.lastgroup == "iban":
                # Groups of other text may follow: the longest run of whole groups that is valid counts.
                for gap in reversed(list(re.finditer(" ", match[0]))):
                    shorter = _PATTERN.match(text, match.start(), match.start() + gap.start())
                    if shorter and shorter.lastgroup == "iban" and (found := self.replace(shorter)):
                        match = shorter
                        break
            if found is None:
                start = match.start() + 1
                while start < len(text) and text[start].isdigit() and text[start - 1].isdigit():
                    start += 1
                continue
            kind, new = found
            out += [text[at : match.start()], new]
            size += match.start() - at
            spans.append((kind, size, size + len(new)))
            size += len(new)
            start = at = match.end()
        return "".join([*out, text[at:]]), spans


def session_key(spark: SparkSession) -> bytes:
    """The key that the session is set to use (KEY_SETTING). Where none is set, a random one is drawn and set, so that values
    are linked within the session alone."""
    known = spark.conf.get(KEY_SETTING, None)
    if not known:
        known = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, known)
    return bytes.fromhex(known)


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", details: bool = False) -> DataFrame:
    """``docs``, all columns, with personal data in ``text_col`` replaced by pseudonyms of the same format.

    Found are e-mail addresses (the part before the @), secrets after a name such as ``password=``, access
    keys, long hexadecimal tokens, IBANs, dates, IPv4 addresses, social security numbers, payment card and
    phone numbers; those with a check digit, a range or a calendar only if valid, and pseudonyms are as valid.
    Pseudonyms depend on the key, the kind and the value alone, so equal values stay linked across documents
    and formats (phone numbers with or without separators and country code, dates in any order), each shape's values are
    permuted one to one, and whoever has the key can invert them; an empty key is refused. With ``details``, columns pii_count (long) and
    pii_spans (array of kind, start, end) follow; input columns of these names are replaced.

    Null and empty texts stay; whole texts of any length are read; repeated rows get the same pseudonyms; an
    empty table gives an empty result.
    """
    if not key:
        raise ValueError("a key is needed")
    extra = ("pii_count", "pii_spans") if details else ()
    docs = docs.drop(*extra)
    names = docs.columns
    schema = docs.schema
    if details:
        schema = T.StructType([*schema.fields, T.StructField("pii_count", T.LongType()), T.StructField("pii_spans", T._parse_datatype_string("array<struct<kind:string,start:int,end:int>>"))])
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key)
        for batch in pieces_of(batches, 1000):
            done = [(None, []) if t is None else pseudonyms.rewrite(t) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array([t for t, _ in done], pa.string())
            if details:
                columns += [pa.array([len(s) for _, s in done], pa.int64()), pa.array([[dict(kind=k, start=a, end=b) for k, a, b in s] for _, s in done], spans_type)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *extra])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text, pii_count and pii_spans of each document: what the query returns."""
    return pseudonymise(docs.select("doc_id", "text"), key, details=True)
