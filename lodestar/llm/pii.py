"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by one pattern, validated (Luhn's check, octets, calendar, number ranges) and
permuted within their own format by a keyed Feistel network: two halves take turns, each moved
by a keyed hash of the other, modulo the size of its range.  Such a step can be undone, so the
map is one-to-one on the values of a format; equal values get equal pseudonyms in all documents.
Lengths stay, but for the octets of addresses.  What fails validation stays as it is.

The key is a parameter, and only its SHA-256 enters the plan.  ``key_of`` takes it from the session's
configuration, where a secret store may put it; without one it makes a key of its own, so nobody who
reads this file can undo the pseudonyms.

Patterns are matched in time linear in the text: what may repeat is possessive, and what Java would
match by recursion is bounded.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Setting of the session that holds the key.
KEY_SETTING = "spark.lodestar.pii.key"
ROUNDS = 8

# Fixed patterns of the formats.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}+"
ACCESS_KEY = r"(?<![A-Za-z0-9_])AKIA[0-9A-Z]{16}(?![A-Za-z0-9_])"
SECRET = (
    r"(?<![A-Za-z0-9_])(?i:password|passwd|token|secret|api_?key) {0,3}[=:] {0,3}\"?"
    r"(?=[A-Za-z_/+-]{0,64}[0-9])[A-Za-z0-9_/+-]{8,}+"
)
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![A-Za-z0-9_.])(?:{OCTET}\.){{3}}{OCTET}(?![A-Za-z0-9_]|\.[0-9])"
DATE = (
    r"(?<![A-Za-z0-9_/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
    r"|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![A-Za-z0-9_/-]|\.[0-9])"
)
SSN = r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])"
PHONE = r"(?<![A-Za-z0-9_+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9_])"
CARD = (
    r"(?<![A-Za-z0-9_])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})"
    r"(?![A-Za-z0-9_])"
)
ANY = "|".join((EMAIL, ACCESS_KEY, SECRET, IP, DATE, SSN, PHONE, CARD))
#: Every value holds one of these; rows without any are not searched further.
HINT = "[0-9@]|AKIA"

FIRST_DAY = "1900-01-01"
#: 250 x 292 days from FIRST_DAY on, to 13 November 2099.
WEEKS, STEP = 250, 292


def _prf(key: str, tweak: Column, turn: Column, value: Column) -> Column:
    """SHA-256 in hex of key, format, round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), value.cast("string")).cast("binary"), 256)


def _number(hexdigits: Column) -> Column:
    return F.conv(hexdigits, 16, 10).cast("long")


def feistel(key: str, tweak: Column, left: Column, right: Column, n_left: Column, n_right: Column) -> Column:
    """Struct (l, r): a permutation of the pairs below (n_left, n_right)."""

    def turn(s: Column, i: Column) -> Column:
        other = F.when(i % 2 == 0, s["r"]).otherwise(s["l"])
        moved = F.when(i % 2 == 0, s["l"]).otherwise(s["r"])
        size = F.when(i % 2 == 0, n_left).otherwise(n_right)
        new = (moved + _number(F.substring(_prf(key, tweak, i, other), 1, 12))) % size
        return F.when(i % 2 == 0, F.struct(new.alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), new.alias("r"))
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.reduce(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _shift(text: Column, digest: Column) -> Column:
    """Each letter or digit moved within its class by a byte of the digest; others stay."""

    def one(c: Column, i: Column) -> Column:
        by = _number(F.substring(digest, (i % 32) * 2 + 1, F.lit(2))).cast("int")
        within = lambda first, size: F.char(F.ascii(F.lit(first)) + (F.ascii(c) - F.ascii(F.lit(first)) + by) % size)
        return (
            F.when(c.between("0", "9"), within("0", 10))
            .when(c.between("a", "z"), within("a", 26))
            .when(c.between("A", "Z"), within("A", 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(text), one), "")


def _moved(text: Column, digest: Column) -> Column:
    """``_shift`` with the digest worked out once, not for each character."""
    return _let(digest, lambda d: _shift(text, d))


def feistel_text(key: str, tweak: Column, text: Column) -> Column:
    """A permutation of the texts with the same classes of characters in the same places."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(_moved(s["l"], _prf(key, tweak, i, s["r"])).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), _moved(s["r"], _prf(key, tweak, i, s["l"])).alias("r"))
        )

    return F.reduce(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in turn by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + is_digit.cast("int")).alias("at"),
        )

    return F.reduce(_chars(form), start, step, lambda s: s["out"])


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn's sum; the last digit is doubled if ``doubled`` is 1, then every other."""
    n = F.length(digits)

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - 1 - i) % 2 == (0 if doubled else 1), twice).otherwise(d)

    return F.reduce(F.transform(_chars(digits), part), F.lit(0), lambda a, x: a + x)


def _card(key: str, m: Column) -> Column:
    def go(d: Column) -> Column:
        middle = F.length(d) - 2
        h = F.floor(middle / 2).cast("int")
        left, right = F.substring(d, F.lit(2), h), F.substring(d, h + 2, middle - h)
        power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
        tweak = F.concat(F.lit("card"), F.length(d).cast("string"), F.substring(d, 1, 1))
        halves = feistel(key, tweak, left.cast("long"), right.cast("long"), power(h), power(middle - h))

        def done(s: Column) -> Column:
            body = F.concat(F.substring(d, 1, 1), F.lpad(s["l"].cast("string"), h, "0"), F.lpad(s["r"].cast("string"), middle - h, "0"))
            check = ((10 - _luhn_sum(body, 1) % 10) % 10).cast("string")
            return _refill(m, F.concat(body, check))

        return F.when(_luhn_sum(d, 0) % 10 == 0, _let(halves, done)).otherwise(m)

    return _let(_digits(m), go)


def _phone(key: str, m: Column) -> Column:
    def go(d: Column) -> Column:
        n = F.length(d)
        area, office = F.substring(d, n - 9, F.lit(3)).cast("long"), F.substring(d, n - 6, F.lit(3)).cast("long")
        line = F.substring(d, n - 3, F.lit(4)).cast("long")
        # codes below 200 are not given out; a code stays on its side of that line
        base = lambda c: F.when(c < 200, F.lit(0)).otherwise(F.lit(200)).cast("long")
        size = lambda c: F.when(c < 200, F.lit(200)).otherwise(F.lit(800)).cast("long")
        tweak = F.concat_ws(",", F.lit("phone"), base(area).cast("string"), base(office).cast("string"))
        halves = feistel(key, tweak, area - base(area), (office - base(office)) * 10000 + line, size(area), size(office) * 10000)
        pad = lambda c, k: F.lpad(c.cast("string"), k, "0")
        return _let(
            halves,
            lambda s: _refill(
                m,
                F.concat(
                    F.substring(d, F.lit(1), n - 10), pad(s["l"] + base(area), 3),
                    pad(F.floor(s["r"] / 10000) + base(office), 3), pad(s["r"] % 10000, 4),
                ),
            ),
        )

    return _let(_digits(m), go)


def _ip(key: str, m: Column) -> Column:
    def go(o: Column) -> Column:
        n = F.transform(o, lambda x: x.cast("long"))
        halves = feistel(key, F.lit("ip"), n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536))
        octets = lambda s: [F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256]
        return _let(halves, lambda s: F.concat_ws(".", *(x.cast("string") for x in octets(s))))

    # an address may change its length: the digits of the octets are what its format leaves open
    return _let(F.split(m, r"\."), go)


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, *at).cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    halves = feistel(key, F.lit("ssn"), area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))

    def done(s: Column) -> Column:
        a = s["l"] + 1 + (s["l"] >= 665).cast("long")
        pad = lambda c, k: F.lpad(c.cast("string"), k, "0")
        return F.concat_ws("-", pad(a, 3), pad(F.floor(s["r"] / 9999) + 1, 2), pad(s["r"] % 9999 + 1, 4))

    return F.when(valid, _let(halves, done)).otherwise(m)


def _date(key: str, m: Column) -> Column:
    """Dates with the year first, the day first (dots), or the month first (slashes); a slashed date
    whose first number cannot be a month has the day first."""
    first_year = m.rlike("^[0-9]{4}")
    slashed = m.contains("/") & ~first_year
    day_first = slashed & (F.substring(m, 1, 2).try_cast("int") > 12)
    month_first = slashed & ~day_first
    year = F.when(first_year, F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4))
    month = F.when(first_year, F.substring(m, 6, 2)).when(month_first, F.substring(m, 1, 2)).otherwise(F.substring(m, 4, 2))
    day = F.when(first_year, F.substring(m, 9, 2)).when(month_first, F.substring(m, 4, 2)).otherwise(F.substring(m, 1, 2))

    def go(n: Column) -> Column:
        halves = feistel(key, F.lit("date"), F.floor(n / STEP), n % STEP, F.lit(WEEKS), F.lit(STEP))

        def done(s: Column) -> Column:
            iso = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * STEP + s["r"]).cast("int")).cast("string")
            y, mo, d = F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2)
            return _refill(m, F.when(first_year, F.concat(y, mo, d)).when(month_first, F.concat(mo, d, y)).otherwise(F.concat(d, mo, y)))

        return F.when((n >= 0) & (n < WEEKS * STEP), _let(halves, done)).otherwise(m)

    date = F.concat_ws("-", year, month, day).try_cast("date")
    number = F.datediff(date, F.lit(FIRST_DAY).cast("date")).cast("long")
    moved = F.when(day_first, _late_day(key, m, date)).otherwise(_let(number, go))
    return F.when(year.between("1900", "2099") & date.isNotNull(), moved).otherwise(m)


def _late_day(key: str, m: Column, date: Column) -> Column:
    """dd/mm/yyyy with a day above 12, moved among dates of which the same can be told.

    Days that every month has move with the month; the 29th and 30th with the months but February;
    the 31st with its seven months; the 29th of February with the leap years.
    """

    def go(d: Column) -> Column:
        y, mo, day = F.year(d).cast("long"), F.month(d), F.dayofmonth(d)
        leap = (mo == 2) & (day == 29)
        months = F.when(day < 29, F.array(*map(F.lit, range(1, 13)))).when(leap, F.array(F.lit(2)))
        months = months.when(day < 31, F.array(*map(F.lit, (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)))).otherwise(F.array(*map(F.lit, (1, 3, 5, 7, 8, 10, 12))))
        first = F.when(day < 29, F.lit(13)).when(leap | (day < 31), F.lit(29)).otherwise(F.lit(31))
        n_days = F.when(day < 29, F.lit(16)).when(leap | (day == 31), F.lit(1)).otherwise(F.lit(2))
        left = F.when(leap, F.floor((y - 1904) / 4)).otherwise(y - 1900)

        def moved(ms: Column) -> Column:
            right = (day - first) * F.size(ms) + F.array_position(ms, mo) - 1
            tweak = F.concat_ws(",", F.lit("day first"), first.cast("string"), F.size(ms).cast("string"))
            halves = feistel(key, tweak, left, right, F.when(leap, F.lit(49)).otherwise(F.lit(200)), F.size(ms) * n_days)

            def done(s: Column) -> Column:
                pad = lambda c, k: F.lpad(c.cast("string"), k, "0")
                new = F.when(leap, s["l"] * 4 + 1904).otherwise(s["l"] + 1900)
                at = (s["r"] % F.size(ms)).cast("int")
                return F.concat_ws("/", pad(F.floor(s["r"] / F.size(ms)) + first, 2), pad(F.get(ms, at), 2), pad(new, 4))

            return _let(halves, done)

        return _let(months, moved)

    return _let(date, go)


def _email(key: str, m: Column) -> Column:
    at = F.instr(m, "@")
    return F.concat(feistel_text(key, F.lit("email"), F.substring(m, F.lit(1), at - 1)), F.substring(m, at, F.length(m)))


def _secret(key: str, m: Column) -> Column:
    value = F.regexp_extract(m, "([A-Za-z0-9_/+-]+)$", 1)
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), feistel_text(key, F.lit("secret"), value))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one value that ``ANY`` matched."""
    k = hashlib.sha256(key.encode()).hexdigest()
    whole = lambda p: m.rlike(f"^(?:{p})$")
    out = (
        F.when(m.contains("@"), _email(k, m))
        .when(whole(ACCESS_KEY), F.concat(F.lit("AKIA"), feistel_text(k, F.lit("access"), F.substring(m, 5, 16))))
        .when(m.rlike("[=:]"), _secret(k, m))
        .when(whole(IP), _ip(k, m))
        .when(whole(DATE), _date(k, m))
        .when(whole(SSN), _ssn(k, m))
        .when(whole(PHONE), _phone(k, m))
        .otherwise(_card(k, m))
    )
    return F.coalesce(out, m)


def key_of(spark: SparkSession) -> str:
    """The configured key; a new one, kept nowhere, where none is set."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str = "n_replaced") -> DataFrame:
    """``docs`` with every personal value of ``text`` replaced, and how many were as last column.

    That column is called ``count``, with underscores before it where ``docs`` has such a column.
    Null texts stay null and have none replaced, empty texts likewise; texts of any length are
    searched whole, in time that grows with their length.  Rows, repeated ones too, their order of
    columns and all other columns stay as they are; an empty table gives no rows.
    """
    t = F.col(text)
    count, found, masked = (fresh(docs, c) for c in (count, "__found", "__masked"))
    out = docs.withColumn(
        found, F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    )
    out = out.withColumn(masked, F.transform(found, lambda m: pseudonym(m, key)))
    pieces = F.zip_with(F.split(t, ANY, -1), F.col(masked), lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
    new = F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(t)
    changed = F.size(F.filter(F.zip_with(found, masked, lambda a, b: a != b), lambda x: x))
    return out.select(*(new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns), changed.alias(count))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its own columns and personal values replaced; ``n_chars`` follows the text.

    Rows are treated as by ``pseudonymised``.
    """
    made = pseudonymised(docs, key)
    out = made.drop(made.columns[-1])
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else out
