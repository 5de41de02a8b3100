"""Pseudonyms for personal data: numbers and dates permuted within their own format.

Values are found by patterns and validated (check digits, ranges, the calendar). A keyed Feistel
network then permutes the set of all values of the same format: halves take turns, each is shifted by
a hash of the other, modulo its own size, so any product of two sizes is covered and nothing walks in
cycles. Equal values get equal pseudonyms in every document, different values different ones.
Separators, brackets and lengths stay, check digits are made to fit. E-mail addresses get a name
from a keyed hash. Only DataFrame functions are used; rows are independent, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.llm.common import prepare
from tallyglass.llm.spans import matches, replaced

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", (184, 397)  # 73,048 days, to 2099-12-30
SSN_AREAS = 898

#: The patterns of values that are looked at, in the order of their replacement.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
            r"(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|(?<![0-9][ -])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}"
            r"\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![ -][0-9]))(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]"
             r"[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})"
             r"(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\1[0-9]{4})(?![0-9])",
}


def long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("bigint")


def keyed(key: str, *parts) -> Column:
    """A whole number below 2^60 from a keyed hash."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(x: Column, a, b, key: str, kind: str) -> Column:
    """A keyed permutation of the whole numbers below a * b."""
    a, b = long(a), long(b)
    start = F.struct(F.call_function("div", x, b).alias("l"), F.pmod(x, b).alias("r"),
                     a.alias("m"), b.alias("n"))

    def turn(s, i):
        shift = F.pmod(keyed(key, F.lit(kind), s["m"], s["n"], i, s["r"]), s["m"])
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + shift, s["m"]).alias("r"),
                        s["n"].alias("m"), s["m"].alias("n"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return F.element_at(F.transform(F.array(end), lambda s: s["l"] * s["n"] + s["r"]), 1)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Digits (18 at most) as other digits of the same number."""
    n = F.char_length(digits)
    power = lambda k: F.rpad(F.lit("1"), k.cast("int") + 1, "0").cast("bigint")
    left = F.floor(n / 2)
    out = feistel(digits.cast("bigint"), power(left), power(n - left), key, kind)
    return F.lpad(out.cast("string"), n, F.lit("0"))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refilled(m: Column, digits: Column) -> Column:
    """m with its digits, in order, replaced by others; all else stays in place."""
    at = F.sequence(F.lit(1), F.char_length(m))
    return F.array_join(F.transform(at, lambda i: F.when(
        F.substring(m, i, F.lit(1)).between("0", "9"),
        F.substring(digits, F.char_length(digits_of(F.substring(m, F.lit(1), i))), F.lit(1))
    ).otherwise(F.substring(m, i, F.lit(1)))), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum, modulo ten."""
    n = F.char_length(digits)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def mod97(text: Column) -> Column:
    """The remainder by 97 of digits and letters, a letter counting from ten."""
    def add(total, i):
        c = F.substring(text, i, F.lit(1))
        return F.when(c.between("0", "9"), total * 10 + F.ascii(c) - 48).otherwise(
            total * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.char_length(text)), F.lit(0), add)


def _iban_parts(m: Column):
    whole = F.replace(m, F.lit(" "), F.lit(""))
    return whole, F.substring(whole, 1, 2), F.substring(whole, F.lit(5), F.char_length(whole))


def _last(digits: Column, most: int) -> Column:
    """How many of the last digits are permuted."""
    return F.least(F.char_length(digits), F.lit(most))


def _tail_permuted(digits: Column, most: int, key: str, kind: str) -> Column:
    n = F.char_length(digits)
    k = _last(digits, most)
    tail = permuted_digits(F.substring(digits, n - k + 1, k), key, kind)
    return F.concat(F.substring(digits, F.lit(1), n - k), tail)


def _date(m: Column) -> Column:
    day = F.regexp_replace(m, "[/.]", "-")
    return F.coalesce(F.try_to_date(day, "yyyy-MM-dd"), F.try_to_date(day, "dd-MM-yyyy"),
                      F.try_to_date(day, "MM-dd-yyyy"))


def _day(m: Column) -> Column:
    return F.datediff(_date(m), F.lit(FIRST_DAY).cast("date")).cast("bigint")


def _ssn(m: Column):
    return [F.substring(m, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4))]


def valid(kind: str, m: Column) -> Column:
    """Whether a match is a value of its kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "iban":
        whole, country, rest = _iban_parts(m)
        return (mod97(F.concat(rest, country, F.substring(whole, 3, 2))) == 1) & (
            F.char_length(digits_of(rest)) > 1)
    if kind == "card":
        return luhn(digits_of(m)) == 0
    if kind == "ssn":
        area, group, serial = _ssn(m)
        return (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    if kind == "phone":
        return F.char_length(digits_of(m)).between(7, 15)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    return F.coalesce(_day(m).between(0, DAYS[0] * DAYS[1] - 1), F.lit(False))


def pseudonym(kind: str, m: Column, key: str) -> Column:
    """The pseudonym of a valid value, in the value's own format."""
    if kind == "email":
        return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws(
            ":", F.lit(key), F.lit(kind), F.lower(m)), 256), 1, 12), F.lit("@mail.invalid"))
    if kind == "iban":
        _, country, rest = _iban_parts(m)
        digits = _tail_permuted(digits_of(rest), 18, key, kind)
        check = 98 - mod97(F.concat(refilled(rest, digits), country, F.lit("00")))
        return refilled(m, F.concat(F.lpad(check.cast("string"), 2, "0"), digits))
    if kind == "card":
        digits = digits_of(m)
        new = permuted_digits(F.substring(digits, F.lit(1), F.char_length(digits) - 1), key, kind)
        check = (10 - luhn(F.concat(new, F.lit("0")))) % 10
        return refilled(m, F.concat(new, check.cast("string")))
    if kind == "ssn":
        area, group, serial = _ssn(m)
        index = area - F.when(area < 666, 1).otherwise(2)
        new = feistel((index * 99 + group - 1) * 9999 + serial - 1, SSN_AREAS * 99, 9999, key, kind)

        def written(x):
            high = F.floor(x / 9999).cast("bigint")
            area_ = F.floor(high / 99).cast("bigint")
            return F.concat_ws(
                "-", F.lpad((area_ + F.when(area_ < 665, 1).otherwise(2)).cast("string"), 3, "0"),
                F.lpad((high % 99 + 1).cast("string"), 2, "0"),
                F.lpad((x % 9999 + 1).cast("string"), 4, "0"))

        return F.element_at(F.transform(F.array(new), written), 1)
    if kind == "phone":
        return refilled(m, _tail_permuted(digits_of(m), 10, key, kind))
    if kind == "ip":
        number = F.aggregate(F.split(m, r"\."), F.lit(0).cast("bigint"),
                             lambda a, x: a * 256 + x.cast("bigint"))
        return F.element_at(F.transform(
            F.array(feistel(number, 65536, 65536, key, kind)),
            lambda x: F.concat_ws(".", *[(F.shiftright(x, s) % 256).cast("string")
                                         for s in (24, 16, 8, 0)])), 1)
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(_day(m), *DAYS, key, kind).cast("int"))
    day_first = F.try_to_date(F.regexp_replace(m, "[/.]", "-"), "dd-MM-yyyy").isNotNull()

    def written(day):
        parts = [F.date_format(day, f) for f in ("dd", "MM", "yyyy")]
        form = F.when(day_first, F.concat_ws("/", *parts)).otherwise(
            F.concat_ws("/", parts[1], parts[0], parts[2]))
        return F.when(F.substring(m, 5, 1) == "-", F.date_format(day, "yyyy-MM-dd")).otherwise(
            F.replace(form, F.lit("/"), F.substring(m, 3, 1)))

    return F.element_at(F.transform(F.array(new), written), 1)


def _counted(kind: str) -> Column:
    return F.size(F.filter("__found", lambda m: valid(kind, m)))


def _changed(kind: str, key: str):
    return lambda m: F.when(valid(kind, m), pseudonym(kind, m, key)).otherwise(m)


def pseudonymize(docs: DataFrame, key: str, keep: tuple = ("doc_id",), text: str = "text"
                 ) -> DataFrame:
    """The kept columns, text with pseudonyms, and n_<kind>: how many values of each kind it had.

    Matches that fail validation stay as they are. Null texts stay null and have no values; empty
    texts stay empty. Repeated rows stay and are treated alike; an empty table gives no rows. Columns
    of docs that are not kept are not read; a kept column of an output's name is replaced.
    """
    prepare(docs.sparkSession)
    names = [f"n_{k}" for k in PATTERNS]
    keep = [c for c in keep if c not in ("text", *names)]
    out = docs.select(*keep, F.col(text).cast("string").alias("text"))
    for kind, pattern in PATTERNS.items():
        source = F.coalesce("text", F.lit(""))
        out = out.withColumn("__found", matches(source, pattern))
        count, change = _counted(kind), _changed(kind, key)
        out = out.select(
            *keep, *[n for n in names if n in out.columns],
            F.when(F.size("__found") > 0, count).otherwise(0).cast("long").alias(f"n_{kind}"),
            F.when(F.size("__found") > 0, replaced(source, pattern, F.col("__found"), change)
                   ).otherwise(F.col("text")).alias("text"))
    return out.select(*keep, "text", *names)
