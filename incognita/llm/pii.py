"""Format-preserving pseudonyms for personal data: a keyed Feistel permutation per format.

A value that is found and valid is turned into a number below the size of its
format, permuted by an alternating Feistel network keyed with HMAC (BLAKE2b) and
the format as tweak, walked along its cycle until it is valid again, and written
back in the same format. The permutation is one to one, so equal values get
equal pseudonyms in all documents, different ones differ, and the holder of the
key can invert it (``reveal``).

Values beside other numbers: where the longest match is not valid, its beginnings
that end at a separator are tried (for an IBAN its country's length first), and
the search goes on just after the begin of what is not valid. A phone ends before
a valid value of another kind. Whether a further group of digits is part of a
phone cannot be told in all countries; it is taken, and the digits past the
shortest number are permuted one by one under those before them, so that a phone
has the same pseudonym with or without such a group.

| kind | valid if | stays |
|---|---|---|
| card | 13 to 19 digits, Luhn sum 0 | separators, first digit, Luhn sum |
| phone | +country code and 8 to 15 digits in groups, or a grouped North American number | separators, country code, North American area and exchange from 2 |
| ssn | area not 000, 666 or from 900, group not 00, serial not 0000 | dashes and validity |
| iban | ISO 7064 remainder 1 | country, places of letters and digits, remainder |
| ipv4 | four numbers up to 255 | the form |
| date | a day from 1900 to 2099 as y-m-d, d.m.y, m/d/y or d/m/y | the form |
| email | one @, a domain with a dot | domain, places of letters and digits |
| secret | after password, secret, token or key and = or :, or an AKIA key | places of letters and digits |

Scale: one narrow pass; whole texts are read, and texts without a digit or an @
cannot hold any of these but secrets, which have their own words.

Defined cases: null and empty texts stay as they are with nothing found; values
that look like a kind but are not valid in any of these ways stay; overlapping
finds go to the first begin, then to the kind first in the pattern; repeated rows get equal results; other columns stay, and
result columns get names that the documents do not have.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from incognita.llm.common import col, fresh, raw

ROUNDS = 10
#: For the registered query and tests only; pass your own secret.
DEMO_KEY = b"incognita demonstration key"

_PATTERN = re.compile(
    r"(?P<secret>(?:(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<value>[A-Za-z0-9+/_\-]{8,})"
    r"|(?<![A-Za-z0-9])AKIA(?P<value2>[A-Z0-9]{16})(?![A-Za-z0-9]))"
    r"|(?P<email>(?<![A-Za-z0-9._%+\-])(?P<local>[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63})@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9]))"
    r"|(?P<ipv4>(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9]))"
    r"|(?P<date>(?<![0-9A-Za-z./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z]|[./\-][0-9]))"
    r"|(?P<ssn>(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9]))"
    r"|(?P<nanp>(?<![0-9A-Za-z+])(?:\+?1[ .\-])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .\-])[2-9][0-9]{2}[ .\-][0-9]{4}(?![0-9A-Za-z]|-[0-9])"
    r"|(?<![0-9A-Za-z+])\+1[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .\-/]?\(?[0-9]{1,4}\)?){2,5}(?![0-9A-Za-z]))"
    r"|(?P<card>(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){2}[ \-][0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9A-Za-z]|-[0-9]))")

#: What any match holds at least; the rest of the pattern is then not tried.
_MAY = re.compile(r"[0-9@]|password|passwd|pwd|secret|token|key|AKIA", re.IGNORECASE)

# The lengths of IBANs by country.
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AO": 25, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BF": 27, "BG": 22, "BH": 22, "BI": 27,
    "BJ": 28, "BR": 29, "BY": 28, "CF": 27, "CG": 27, "CH": 21, "CI": 28, "CM": 27, "CR": 22, "CV": 25, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "DZ": 24, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27,
    "GA": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GQ": 28, "GR": 27, "GT": 28, "GW": 25, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IR": 26, "IS": 26, "IT": 27, "JO": 30, "KM": 28, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MA": 28, "MC": 27, "MD": 24, "ME": 22, "MG": 27, "MK": 19, "ML": 28,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "MZ": 25, "NE": 28, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SN": 28, "SO": 23, "ST": 25, "SV": 28, "TD": 28, "TG": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20, "YE": 30,
}
_SEPARATORS = " .-/("

_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Permutation:
    """Keyed permutations of range(n), one for each tweak."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.sha256(key).digest(), rounds

    def _round(self, tweak: bytes, i: int, half: int, size: int) -> int:
        n = (max(half.bit_length(), size.bit_length()) + 7) // 8 + 1
        wide = b""
        while len(wide) < n + 8:  # far wider than size, so that the remainder is even
            wide += hashlib.blake2b(b"%d/%d/%d/" % (i, half, len(wide)) + tweak, key=self.key).digest()
        return int.from_bytes(wide[:n + 8], "big") % size

    def once(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        tweak += b"/%d" % n
        while True:  # a * b may exceed n: walk the cycle back into the range
            left, right = divmod(x, b)
            for i in reversed(range(self.rounds)) if back else range(self.rounds):
                sign = -1 if back else 1
                if i % 2:
                    right = (right + sign * self._round(tweak, i, left, b)) % b
                else:
                    left = (left + sign * self._round(tweak, i, right, a)) % a
            x = left * b + right
            if x < n:
                return x

    def __call__(self, x: int, n: int, kind: str, back: bool = False, valid=lambda x: True) -> int:
        """The image of x among the valid numbers below n (x is one)."""
        if n <= 1:
            return x
        while True:
            x = self.once(x, n, kind.encode(), back)
            if valid(x):
                return x


def luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _refill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in form)


def _digits(form: str) -> str:
    return re.sub("[^0-9]", "", form)


#: Characters of a value that are permuted as one number; longer values go block by block.
BLOCK = 64


def _mixed(form: str, permute, kind: str, back: bool) -> str:
    """Permute letters and digits within their kinds of characters, at their places.

    A value longer than ``BLOCK`` is permuted in blocks, from the front and then
    from the end; each block's tweak is a digest of the blocks before it as they
    were, so every block depends on the whole value and time grows with its length.
    """
    if len(form) <= BLOCK:
        return _block(form, permute, kind, back)
    blocks = [form[i:i + BLOCK] for i in range(0, len(form), BLOCK)]
    for turn in (1, 0) if back else (0, 1):
        order = range(len(blocks)) if turn == 0 else range(len(blocks) - 1, -1, -1)
        chain = hashlib.blake2b(f"{kind}/{turn}/{len(form)}".encode())
        for i in order:
            was, new = blocks[i], _block(blocks[i], permute, f"{kind}/{chain.hexdigest()[:32]}", back)
            chain.update((new if back else was).encode())
            blocks[i] = new
    return "".join(blocks)


def _block(form: str, permute, kind: str, back: bool) -> str:
    bases = [(ord("0"), 10) if "0" <= c <= "9" else (ord("a"), 26) if "a" <= c <= "z" else (ord("A"), 26) if "A" <= c <= "Z" else (ord(c), 1) for c in form]
    x, n = 0, 1
    for c, (low, size) in zip(form, bases, strict=True):
        x, n = x * size + ord(c) - low, n * size
    x = permute(x, n, kind + "/" + "".join(chr(low) if size > 1 else c for c, (low, size) in zip(form, bases, strict=True)), back)
    out = []
    for low, size in reversed(bases):
        x, d = divmod(x, size)
        out.append(chr(low + d))
    return "".join(reversed(out))


def _iban_check(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


class Pseudonyms:
    """Replaces what it finds in a text."""

    def __init__(self, key: bytes):
        self.permute = Permutation(key)

    def card(self, form: str, back: bool) -> str | None:
        d = _digits(form)
        if not 13 <= len(d) <= 19 or luhn(d):
            return None
        body = d[1:-1]
        new = d[0] + f"{self.permute(int(body), 10 ** len(body), 'card' + d[0], back):0{len(body)}d}"
        return _refill(form, new + str(-luhn(new + "0") % 10))

    def nanp(self, form: str, back: bool) -> str | None:
        d = _digits(form)
        code, own = d[:-10], d[-10:]
        x = int(own)
        new = self.permute(x, 10**10, "nanp", back, lambda x: x // 10**9 >= 2 and x // 10**6 % 10 >= 2)
        return _refill(form, code + f"{new:010d}")

    def phone(self, form: str, back: bool) -> str | None:
        code, d = _digits(re.match(r"\+[0-9]*", form)[0]), _digits(form)
        own = d[len(code):]
        if not 8 <= len(d) <= 15 or len(own) < 5 or form.count("(") != form.count(")"):
            return None
        core = max(5, 8 - len(code))  # the digits of the shortest number
        old, new = own[:core], f"{self.permute(int(own[:core]), 10 ** core, 'phone' + code, back):0{core}d}"
        for d in own[core:]:
            y = str(self.permute(int(d), 10, f"phone{code}/{new if back else old}", back))
            old, new = old + d, new + y
        return _refill(form, code + new)

    def ssn(self, form: str, back: bool) -> str | None:
        def valid(x):
            area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
            return 0 < area < 900 and area != 666 and group and serial
        x = int(_digits(form))
        return _refill(form, f"{self.permute(x, 10**9, 'ssn', back, valid):09d}") if valid(x) else None

    def ipv4(self, form: str, back: bool) -> str | None:
        parts = form.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        x = self.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4", back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def iban(self, form: str, back: bool) -> str | None:
        bare = form.replace(" ", "")
        if not 15 <= len(bare) <= 34 or _iban_check(bare) != 1:
            return None
        body = _mixed(bare[4:], self.permute, "iban" + bare[:2], back)
        it = iter(f"{bare[:2]}{98 - _iban_check(bare[:2] + '00' + body):02d}{body}")
        return "".join(c if c == " " else next(it) for c in form)

    def date(self, form: str, back: bool) -> str | None:
        n = [int(x) for x in re.split(r"[-./]", form)]
        first = n[0] > 12  # of a date with slashes: the day comes first
        y, m, d = n if form[4] == "-" else (n[2], n[1], n[0]) if form[2] == "." or first else (n[2], n[0], n[1])
        try:
            x = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        if not _FIRST <= x <= _LAST:
            return None
        slashed = form[2] == "/" and first
        x = _FIRST + self.permute(x - _FIRST, _LAST - _FIRST + 1, "date", back, lambda x: not slashed or datetime.date.fromordinal(_FIRST + x).day > 12)
        t = datetime.date.fromordinal(x)
        return f"{t.year}-{t.month:02d}-{t.day:02d}" if form[4] == "-" else f"{t.day:02d}{form[2]}{t.month:02d}{form[2]}{t.year}" if form[2] == "." or first else f"{t.month:02d}/{t.day:02d}/{t.year}"

    def replace(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int, str]]]:
        """(new text, (kind, begin, stop, pseudonym) of each find in the old one)."""
        if not _MAY.search(text):
            return text, []
        out, at, found, m = [], 0, [], _PATTERN.search(text)
        while m:
            got = self._find(text, m, back)
            if got:
                kind, begin, stop, new = got
                out += [text[at:begin], new]
                found.append(got)
                at = stop
            m = _PATTERN.search(text, at if got else m.start() + 1)
        return ("".join(out) + text[at:], found) if found else (text, [])

    def _find(self, text: str, m: re.Match, back: bool) -> tuple[str, int, int, str] | None:
        """(kind, begin, stop, pseudonym) of the valid value that begins where a match does."""
        if m["secret"]:
            begin, stop = m.span("value") if m["value"] else m.span("value2")
            return "secret", begin, stop, _mixed(text[begin:stop], self.permute, "secret", back)
        if m["email"]:
            begin, stop = m.span("local")
            return "email", begin, stop, _mixed(m["local"], self.permute, "email", back)
        kind, begin = m.lastgroup, m.start()
        for stop in self._stops(text, m):
            new = getattr(self, kind)(text[begin:stop], back)
            if new is not None:
                return "phone" if kind == "nanp" else kind, begin, stop, new
        return None

    def _stops(self, text: str, m: re.Match) -> list[int]:
        """Where a value that begins with a match may end, the likeliest first."""
        kind, begin, end = m.lastgroup, m.start(), m.end()
        if kind not in ("iban", "phone"):
            return [end]
        shorter = [i for i in range(end - 1, begin, -1) if text[i] in _SEPARATORS and text[i - 1] not in _SEPARATORS]
        if kind == "iban":
            length = _IBAN_LENGTHS.get(text[begin:begin + 2])
            first = [i for i in [end, *shorter] if i - begin - text.count(" ", begin, i) == length]
        else:
            first = [i for i in shorter if self.phone(text[begin:i], False) and self._begins(text, i)]
        return [*first, end, *shorter]

    def _begins(self, text: str, i: int) -> bool:
        """Whether a valid value other than a phone begins after the separators at i."""
        while text[i] in " .-/":
            i += 1
        m = _PATTERN.match(text, i)
        return m is not None and m.lastgroup in ("ipv4", "date", "ssn", "nanp", "card") and self._find(text, m, False) is not None


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", back: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with one more struct column (its name is returned): the text with pseudonyms, and the finds in the old text."""
    kind = pa.struct([("text", pa.string()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("stop", pa.int64()), ("pseudonym", pa.string())])))])

    @arrow_udf("text string, found array<struct<kind:string,begin:bigint,stop:bigint,pseudonym:string>>")
    def of(texts: pa.Array) -> pa.Array:
        change, rows = Pseudonyms(key), []
        for value in texts:
            value = value.as_py()
            new, found = (None, []) if value is None else change.replace(value.decode("utf-8", "replace"), back)
            rows.append({"text": new, "found": [{"kind": k, "begin": a, "stop": b, "pseudonym": p} for k, a, b, p in found]})
        return pa.array(rows, kind)

    (out,) = fresh(docs, "private")
    return docs.withColumn(out, of.asNondeterministic()(raw(text))), out


def reveal(docs: DataFrame, key: bytes, text: str = "text") -> tuple[DataFrame, str]:
    """The inverse of ``pseudonymise`` under the same key."""
    return pseudonymise(docs, key, text, True)


def pseudonyms(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """doc_id, text with pseudonyms, n_private, kinds."""
    got, c = pseudonymise(docs.select("doc_id", "text"), key)
    return got.select("doc_id", F.col(c)["text"].alias("text"), F.size(F.col(c)["found"]).cast("bigint").alias("n_private"),
                      F.array_sort(F.array_distinct(F.col(c)["found"]["kind"])).alias("kinds"))


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents with pseudonyms in their texts; all columns stay (n_chars too, which some forms change)."""
    got, c = pseudonymise(docs, key)
    return got.select(*[F.col(c)["text"].alias(x) if x == "text" else col(x) for x in docs.columns])
