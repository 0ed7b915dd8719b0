r"""Format-preserving pseudonyms for personal data.

Validated numbers and dates are permuted within their format by a keyed Feistel network, so that
equal values get equal pseudonyms in all documents, different values different ones, and the result
is again a valid value of the form: a card number keeps its length, separators and a right check
digit, a date stays a date. A network over an a * b domain adds keyed round values to the two
halves in turn, modulo a and modulo b, which is a permutation for any a and b, with no retries.

Forms (everything else stays as it is, numbers that don't validate too):
  card     13 to 19 digits, plain or in groups of four, with a right check digit
  phone    +country and 7 to 14 more digits, or a North American number with separators
  address  IPv4, four numbers up to 255
  ssn      ddd-dd-dddd with valid parts
  date     yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy, mm/dd/yyyy that exist, years 1800 to 2199
  email    no number: local part and domain become a keyed digest, the form of an address stays
  secret   value of 16 characters or more after token, secret, password, api key, to its end, dots inside
           included: keyed digest of equal length and case; shorter values stay

A document is cut at its matches and put together again in one projection, by DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.llm.common import once, unused

KEY = "ladderline-pseudonyms-1"
ROUNDS = 8

# Every branch starts at a place where no longer run of its characters is cut, so no text is slow.
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}+"
_SECRET_NAME = r"""(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s{0,3}[:=]\s{0,3}["']?"""
_SECRET = _SECRET_NAME + r"(?=[A-Za-z0-9_/+.=-]{16})[A-Za-z0-9_/+=-]++(?:\.[A-Za-z0-9_/+=-]++)*+"
_ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
# a number after it must not be taken for a further group, so the ten digits after +1 come first
_PHONE = (
    r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d|\.\d)"
    r"|(?<![\d+(])\(?[2-9]\d\d\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"
)
_CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})(?!\d)"
_SSN = r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])"
_DATE = r"(?<!\d)(?:\d{4}-\d\d-\d\d|\d{1,2}([/.])\d{1,2}\1\d{4})(?!\d)"
PATTERN = "|".join(f"(?:{p})" for p in (_EMAIL, _SECRET, _DATE, _ADDRESS, _SSN, _CARD, _PHONE))
_MAYBE = "[0-9@]|(?i:token|secret|pass|key)"

_CYCLE_START, _CYCLE_DAYS = "1800-01-01", 146_097  # the calendar repeats after 400 years
_DATE_HALVES = (189, 773)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(value: Column, a: Column | int, b: Column | int, key: str, form: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def add(half: Column, other: Column, i: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(form), a.cast("string"), b.cast("string"), i.cast("string"), other.cast("string")), 256)
        return (half + F.pmod(_number(digest), size)) % size

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(add(s["l"], s["r"], i, a).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), add(s["r"], s["l"], i, b).alias("r")))

    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).alias("r"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return done["l"] * b + done["r"]


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _permuted(digits: Column, key: str, form: str) -> Column:
    """Digits (at most 18) permuted among all numbers of their length."""
    n = F.length(digits)
    low = F.floor(n / 2)
    power = lambda k: F.rpad(F.lit("1"), (k + 1).cast("int"), "0").cast("long")
    left, right = F.substring(digits, F.lit(1), (n - low).cast("int")), F.substring(digits, (n - low + 1).cast("int"), low.cast("int"))
    a, b = power(n - low), power(low)
    value = left.cast("long") * b + F.when(low > 0, right.cast("long")).otherwise(F.lit(0))
    return F.lpad(feistel(value, a, b, key, form).cast("string"), n, "0")


def _refilled(value: Column, digits: Column) -> Column:
    """`value` with its digits replaced in order by `digits`."""
    place = lambda i: F.length(_digits(F.substring(value, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(
        c.rlike(r"^\d$"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), "")


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = _permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    # the one lambda argument keeps the permutation from being worked out for each candidate
    checked = F.transform(F.array(body), lambda x: F.element_at(F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(x, c.cast("string"))), _luhn), 1))
    return F.when(_luhn(digits), once(F.element_at(checked, 1), lambda new: _refilled(m, new))).otherwise(m)


# fixed values: the numbering plan's country codes of one and two digits; all others have three
_COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _phone(m: Column, key: str) -> Column:
    digits = _digits(m)
    country = F.when(m.startswith("+"), F.regexp_extract(digits, _COUNTRY, 1)).otherwise(F.lit(""))
    own = F.substring(digits, F.length(country) + 1, F.length(digits))
    valid = F.length(digits).between(8, 15) | ~m.startswith("+")
    return F.when(valid, once(F.concat(country, _permuted(own, key, "phone")), lambda new: _refilled(m, new))).otherwise(m)


def _address(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    part = lambda i: F.element_at(parts, i).cast("long")
    value = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    new = feistel(value, 65536, 65536, key, "address")
    octet = lambda x, shift: F.shiftright(x, shift).bitwiseAND(F.lit(255)).cast("string")
    shown = once(new, lambda x: F.concat_ws(".", *[octet(x, shift) for shift in (24, 16, 8, 0)]))
    return F.when(F.forall(parts, lambda p: p.cast("int") <= 255), shown).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    number = lambda i, n: F.substring(m, i, n).cast("long")
    area, group, serial = number(1, 3), number(5, 2), number(8, 4)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    at = area - 1 - F.when(area > 666, F.lit(1)).otherwise(F.lit(0))
    new = feistel(at * (99 * 9999) + (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

    def shown(x: Column) -> Column:
        place, rest = F.floor(x / (99 * 9999)).cast("long") + 1, F.pmod(x, F.lit(99 * 9999))
        parts = place + F.when(place >= 666, F.lit(1)).otherwise(F.lit(0)), F.floor(rest / 9999) + 1, F.pmod(rest, F.lit(9999)) + 1
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in zip(parts, (3, 2, 4))])

    return F.when(valid, once(new, shown)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    mark = F.regexp_extract(m, "[-/.]", 0)
    parts = F.split(m, "[-/.]")
    first, second, third = (F.element_at(parts, i) for i in (1, 2, 3))
    iso = mark == "-"
    pad = lambda x: F.lpad(x, 2, "0")
    day_first = F.try_to_date(F.concat_ws("-", third, pad(second), pad(first)), "yyyy-MM-dd")
    month_first = F.try_to_date(F.concat_ws("-", third, pad(first), pad(second)), "yyyy-MM-dd")
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.coalesce(day_first, month_first))
    number = F.datediff(day, F.to_date(F.lit(_CYCLE_START))).cast("long")
    new = F.date_add(F.to_date(F.lit(_CYCLE_START)), feistel(number, *_DATE_HALVES, key, "date").cast("int"))

    def shown(x: Column) -> Column:
        part = lambda form: F.date_format(x, form)
        return F.when(iso, part("yyyy-MM-dd")).when(
            day_first.isNotNull(), F.concat(part("dd"), mark, part("MM"), mark, part("yyyy"))).otherwise(
            F.concat(part("MM"), mark, part("dd"), mark, part("yyyy")))

    return F.when(number.between(0, _CYCLE_DAYS - 1), once(new, shown)).otherwise(m)


def _email(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@mail.invalid"))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, f"^{_SECRET_NAME}(.*)$", 1)
    # 128 digits a block; all but the first are numbered
    block = lambda i: F.sha2(F.concat_ws(":", F.lit(key), F.lit("secret"), value, F.when(i > 0, i.cast("string"))), 512)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 128).cast("int")), block)
    digest = F.substring(F.array_join(blocks, ""), F.lit(1), F.length(value))
    shown = F.when(value == F.upper(value), F.upper(digest)).otherwise(digest)
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), shown)


_FORMS: list[tuple[str, Callable[[Column, str], Column]]] = [
    ("@", _email), ("[=:]", _secret), (f"^(?:{_DATE})$", _date), (f"^(?:{_ADDRESS})$", _address),
    (f"^(?:{_SSN})$", _ssn), (f"^(?:{_CARD})$", _card),
]


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of one match of PATTERN; the match itself where it doesn't validate."""
    found = None
    for pattern, make in _FORMS:
        found = F.when(m.rlike(pattern), make(m, key)) if found is None else found.when(m.rlike(pattern), make(m, key))
    return F.coalesce(found.otherwise(_phone(m, key)), m)


def _replaced(docs: DataFrame, key: str, n: str) -> DataFrame:
    """`docs` with its text replaced and a column `n`, the number of values that changed."""
    found, new = unused(docs, "found"), unused(docs, "new")
    matches = F.when(F.col("text").rlike(_MAYBE), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    rows = docs.withColumn(found, matches)
    rows = rows.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key))))
    changed = F.size(F.filter(F.transform(found, lambda m, i: m != F.get(new, i)), lambda x: x))
    rows = rows.withColumn(n, F.when(F.size(found) > 0, changed).otherwise(F.lit(0)).cast("long"))
    gaps = F.split("text", PATTERN, -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(F.coalesce(F.get(new, i - 1), F.lit("")), g)), "")
    return rows.withColumn("text", F.when(F.col(n) > 0, joined).otherwise(F.col("text"))).drop(found, new)


def pseudonymized(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with personal data replaced, and n_replaced, the number of values that changed.

    Null text stays null with 0 replaced; empty text stays empty. Rows are independent: repeated
    rows change alike, and a null doc_id changes nothing. Other columns are ignored. An empty table
    gives no rows.
    """
    n = unused(docs, "n")
    return _replaced(docs, key, n).select("doc_id", "text", F.col(n).alias("n_replaced"))


def pseudonymized_documents(docs: DataFrame, key: str = KEY) -> DataFrame:
    """`docs` with personal data replaced, same columns; n_chars follows the new text."""
    n = unused(docs, "n")
    rows = _replaced(docs, key, n)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col(n) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
