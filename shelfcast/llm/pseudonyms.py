"""Format-preserving pseudonyms of personal data, in SQL functions only.

Validated strings are replaced by others of the same format through a keyed
Feistel permutation of their domain, so equal values get equal pseudonyms in
all documents and different values different ones:

* payment card numbers (13 to 19 digits, blanks or hyphens between groups,
  Luhn digit right), also beside other numbers: of a run of digit groups every
  stretch of whole groups is tried, those that look like an issuer's card in
  its usual groups first, then from the left. The leading six digits and the
  length stay, the digits between are permuted, the Luhn digit is made anew;
* phone numbers with a country code or a bracketed area code: all digits
  after the country code are permuted;
* IPv4 addresses with parts up to 255: the 32 bits are permuted;
* social security numbers with possible groups: the 9 digits are permuted by
  walking on until the result is possible again;
* calendar dates that exist (year-month-day, day.month.year, month/day/year):
  permuted among the 146,097 days of the Gregorian cycle of 400 years they
  lie in, so every result exists (dates of the years 1000 to 1199 whose image
  has a year of three digits stay as they are, and are counted);
* e-mail addresses: the letters and digits of the name are permuted among
  themselves, in blocks of ten; other characters and the domain stay.

The permutation is an alternating Feistel network over Z_a x Z_b with eight
rounds; its round function is the first 13 hex digits of a keyed SHA-256. It
is a bijection for every a and b, so no cycle walking is needed where the
domain is a product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .found import matches, spliced

ROUNDS = 8

#: A run of digits, blanks and hyphens with 13 digits or more; a card is a
#: stretch of its groups. (A repeated group would need stack for each number.)
CARD = r"(?<![\d.-])(?=\d(?:[ -]?\d){12})\d[\d -]*(?!\d|\.\d)"
CARD_DIGITS = (13, 19)
#: First digits and lengths of the large issuers, and the groups cards are printed in.
ISSUER = (r"^(?:4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}"
          r"|3[47]\d{13}|3[0689]\d{12}|35\d{14}|6\d{15,18})$")
PRINTED = r"^(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{4}(?:[ -]\d{3})?|\d{4}(?:[ -]\d{4}){2}[ -]\d|\d{4}[ -]\d{6}[ -]\d{4,5})$"
PHONE = r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{2,4}[ .-]?\d{3,4}|(?<![\d+])\(\d{3}\) \d{3}-\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
SSN = r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
DATE = (r"(?<![\d./-])(?:[1-9]\d{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
        r"|(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.[1-9]\d{3}"
        r"|(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/[1-9]\d{3})(?![\d/-]|\.\d)")
EMAIL = r"[\p{L}0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


def feistel(n: Column, a: Column, b: Column, key: Column) -> Column:
    """Keyed permutation of 0 .. a*b-1 (a, b: positive longs under 2**31)."""
    start = F.struct(F.floor(n / b).cast("long").alias("l"), F.pmod(n, b).cast("long").alias("r"))

    def digest(i: Column, half: Column) -> Column:
        text = F.concat_ws("|", key, i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, F.pmod(s["l"] + digest(i, s["r"]), a)).otherwise(s["l"]).cast("long").alias("l"),
                        F.when(even, s["r"]).otherwise(F.pmod(s["r"] + digest(i, s["l"]), b)).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def permute_digits(digits: Column, key: Column) -> Column:
    """Digit string (up to 18 digits) -> another of the same length."""
    size = F.length(digits)
    a = F.rpad(F.lit("1"), 1 + F.floor(size / 2).cast("int"), F.lit("0")).cast("long")
    b = F.rpad(F.lit("1"), 1 + (size - F.floor(size / 2)).cast("int"), F.lit("0")).cast("long")
    got = feistel(digits.cast("long"), a, b, F.concat_ws("|", key, size.cast("string")))
    return F.lpad(got.cast("string"), size, F.lit("0"))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once."""
    return F.transform(F.array(x), f)[0]


def refill(pattern: Column, digits: Column) -> Column:
    """Put digits in the places of ``pattern``'s digits."""
    chars = F.split(pattern, "")
    done = F.aggregate(
        chars, F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda s, c: F.struct(
            (s["at"] + F.when(c.rlike("[0-9]"), 1).otherwise(0)).cast("int").alias("at"),
            F.concat(s["out"], F.when(c.rlike("[0-9]"), F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out")),
        lambda s: s["out"])
    return done


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is not doubled."""
    back = F.split(F.reverse(digits), "")
    return F.aggregate(F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int")))), F.lit(0), lambda s, d: s + d)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def card_cells(run: Column) -> Column:
    """The groups of a run, each with the blank or hyphen behind it."""
    return F.split(run, "(?<=[ -])")


def card_spans(cells: Column) -> Column:
    """array<struct<at, to>> of the cards in a run: first and last group (from 1), in order. No two overlap."""
    least, most = CARD_DIGITS

    def of(cell: Column, i: Column) -> Column:
        # a card has at most 19 groups
        ends = F.transform(F.slice(cells, i + 1, F.lit(most)), lambda y, j: F.struct(
            (i + 1).alias("at"), (i + j + 1).alias("to"), F.array_join(F.slice(cells, i + 1, j + 1), "").alias("part")))
        return F.filter(ends, lambda z: F.length(_digits(z["part"])).between(least, most)
                        & z["part"].rlike(r"^\d+(?:[ -]\d+)*[ -]?$"))

    def ranked(z: Column) -> Column:
        return let(_digits(z["part"]), lambda d: F.when(luhn_sum(d) % 10 == 0, let(
            F.regexp_replace(z["part"], "[ -]$", "").rlike(PRINTED) & d.rlike(ISSUER), lambda usual: F.struct(
                (~usual).alias("odd"), z["at"].alias("at"), F.when(usual, z["to"]).otherwise(-z["to"]).alias("n"),
                z["to"].alias("to")))))

    found = F.array_sort(F.filter(F.transform(F.flatten(F.transform(cells, of)), ranked), lambda z: z.isNotNull()))
    none = F.array().cast("array<struct<at:int,to:int>>")
    free = lambda out, z: ~F.exists(out, lambda o: (o["at"] <= z["to"]) & (z["at"] <= o["to"]))
    return F.array_sort(F.aggregate(found, none, lambda out, z: F.when(free(out, z), F.concat(
        out, F.array(F.struct(z["at"].alias("at"), z["to"].alias("to"))))).otherwise(out)))


def card(m: Column, key: Column) -> Column:
    """The run ``m`` with its cards replaced."""
    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 6), permute_digits(F.substring(
            d, F.lit(7), F.length(d) - 7), F.concat_ws("|", key, F.lit("card"), F.substring(d, 1, 6))))
        return let(body, lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))

    def text(cells: Column, at: Column, to: Column) -> Column:
        return F.array_join(F.slice(cells, at, F.greatest(F.lit(0), to - at + 1)), "")

    def filled(cells: Column, spans: Column) -> Column:
        # before each card the groups since the one before; after the last, the rest
        parts = F.transform(spans, lambda z, i: F.concat(
            text(cells, F.when(i > 0, F.try_element_at(spans, F.greatest(i, F.lit(1)))["to"] + 1).otherwise(1), z["at"] - 1),
            let(text(cells, z["at"], z["to"]), lambda p: refill(p, let(_digits(p), new)))))
        rest = text(cells, F.coalesce(F.try_element_at(spans, F.lit(-1))["to"], F.lit(0)) + 1, F.size(cells))
        return F.concat(F.array_join(parts, ""), rest)

    return let(card_cells(m), lambda cells: let(card_spans(cells), lambda spans: F.when(
        F.size(spans) > 0, filled(cells, spans)).otherwise(m)))


def phone(m: Column, key: Column) -> Column:
    head = F.regexp_extract(m, r"^\+\d{1,3}", 0)
    rest = F.substring(m, F.length(head) + 1, F.length(m))
    return F.concat(head, let(rest, lambda r: refill(r, permute_digits(_digits(r), F.concat_ws("|", key, F.lit("phone"), head)))))


def ipv4(m: Column, key: Column) -> Column:
    part = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    n = F.aggregate(part, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    got = feistel(n, F.lit(65536).cast("long"), F.lit(65536).cast("long"), F.concat_ws("|", key, F.lit("ip")))
    return let(got, lambda g: F.concat_ws(".", *[F.pmod(F.floor(g / 256**i), F.lit(256)).cast("string") for i in (3, 2, 1, 0)]))


def ssn(m: Column, key: Column) -> Column:
    """First group 001-899 without 666, second 01-99, third 0001-9999: a
    product domain of 898 x 99 x 9999."""
    g = F.split(m, "-")
    first = g[0].cast("long")
    n = (first - 1 - F.when(first > 666, 1).otherwise(0)) * 99 * 9999 + (g[1].cast("long") - 1) * 9999 + g[2].cast("long") - 1
    got = feistel(n, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), F.concat_ws("|", key, F.lit("ssn")))

    def back(v: Column) -> Column:
        i = F.floor(v / (99 * 9999)) + 1
        i = i + F.when(i >= 666, 1).otherwise(0)
        pad = lambda x, w: F.lpad(x.cast("long").cast("string"), w, F.lit("0"))
        return F.concat_ws("-", pad(i, 3), pad(F.pmod(F.floor(v / 9999), F.lit(99)) + 1, 2), pad(F.pmod(v, F.lit(9999)) + 1, 4))
    return let(got, back)


CYCLE = 146_097  # days in 400 Gregorian years = 189 * 773


def iso_day(m: Column) -> Column:
    """Day number of a date match; null if there is no such day."""
    iso = F.when(m.contains("-"), m).when(m.contains("."), F.concat_ws(
        "-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(F.concat_ws(
            "-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    return F.unix_date(iso.try_cast("date"))


def date(m: Column, key: Column) -> Column:
    style = F.when(m.contains("-"), "yyyy-MM-dd").when(m.contains("."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    def new(d: Column) -> Column:
        cycle = F.floor((d - F.unix_date(F.lit("1600-01-01").cast("date"))) / CYCLE)
        base = F.unix_date(F.lit("1600-01-01").cast("date")) + cycle * CYCLE
        got = feistel((d - base).cast("long"), F.lit(189).cast("long"), F.lit(773).cast("long"),
                      F.concat_ws("|", key, F.lit("date")))
        to = F.date_from_unix_date((base + got).cast("int"))
        y, mo, dd = (F.lpad(f(to).cast("string"), w, F.lit("0")) for f, w in ((F.year, 4), (F.month, 2), (F.day, 2)))
        text = (F.when(style == "yyyy-MM-dd", F.concat_ws("-", y, mo, dd))
                .when(style == "dd.MM.yyyy", F.concat_ws(".", dd, mo, y)).otherwise(F.concat_ws("/", mo, dd, y)))
        # a year before 1000 or after 9999 would change the format
        return F.when(F.year(to).between(1000, 9999), text).otherwise(m)
    return let(iso_day(m), lambda d: F.when(d.isNull(), m).otherwise(new(d)))


def email(m: Column, key: Column) -> Column:
    """The name's ASCII letters and digits, read as a base-36 number of 10
    places at a time, are permuted; other characters stay in place."""
    name = F.lower(F.substring_index(m, "@", 1))
    plain = F.regexp_replace(name, "[^a-z0-9]", "")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(plain) - 1) / 10)).cast("int")),
                         lambda i: F.substring(plain, i * 10 + 1, F.lit(10)))

    def block(b: Column) -> Column:
        size = F.length(b)
        low = F.floor(size / 2)
        a, c = F.pow(F.lit(36.0), low).cast("long"), F.pow(F.lit(36.0), size - low).cast("long")
        got = feistel(F.conv(b, 36, 10).cast("long"), a, c,
                      F.concat_ws("|", key, F.lit("mail"), size.cast("string"), F.length(plain).cast("string")))
        return F.lpad(F.lower(F.conv(got.cast("string"), 10, 36)), size, F.lit("0"))

    fresh = F.array_join(F.transform(blocks, lambda b: F.when(F.length(b) > 0, block(b)).otherwise(F.lit(""))), "")

    def fill(digits: Column) -> Column:
        return F.aggregate(
            F.split(name, ""), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
            lambda s, ch: F.struct(
                (s["at"] + F.when(ch.rlike("[a-z0-9]"), 1).otherwise(0)).cast("int").alias("at"),
                F.concat(s["out"], F.when(ch.rlike("[a-z0-9]"), F.substring(digits, s["at"], F.lit(1))).otherwise(ch)).alias("out")),
            lambda s: s["out"])

    return F.concat(let(fresh, fill), F.lit("@"), F.substring_index(m, "@", -1))


KINDS = {"email": (EMAIL, email), "card": (CARD, card), "ssn": (SSN, ssn), "date": (DATE, date),
         "ipv4": (IPV4, ipv4), "phone": (PHONE, phone)}

#: Cheap pattern that a text with a match also matches.
HINT = {"email": "@", "card": r"\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d", "ssn": r"\d-\d\d-\d",
        "date": r"\d[./-]\d\d[./-]\d", "ipv4": r"\d\.\d{1,3}\.\d", "phone": r"\+\d|\(\d"}


def number(kind: str, found: Column) -> Column:
    """How many of the matches count (the patterns check the rest)."""
    if kind == "card":
        return F.aggregate(found, F.lit(0), lambda s, m: s + let(card_cells(m), lambda c: F.size(card_spans(c))))
    if kind == "date":
        return F.size(F.filter(found, lambda m: iso_day(m).isNotNull()))
    return F.size(found)


def pseudonymise(docs: DataFrame, key: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """``docs`` with ``new_text`` and one count ``n_<kind>`` per kind added.

    No shuffle. Null text: null ``new_text``, counts 0. Texts without a valid
    string are unchanged. All columns of ``docs`` are kept as they are
    (its own columns named like the added ones are replaced)."""
    text = F.col("text")

    def count(kind: str) -> Column:
        pattern = KINDS[kind][0]
        n = number(kind, matches(text, pattern))
        return F.when(text.rlike(HINT[kind]) & text.rlike(pattern), n).otherwise(0).cast("long")

    def replaced(kind: str) -> Column:
        pattern, new = KINDS[kind]
        cur = F.col("new_text")
        return F.when(F.col(f"n_{kind}") > 0, spliced(cur, pattern, lambda m: new(m, F.lit(key)))).otherwise(cur)

    out = docs.withColumns({f"n_{k}": count(k) for k in kinds}).withColumn("new_text", text)
    for k in kinds:
        out = out.withColumn("new_text", replaced(k))
    return out
