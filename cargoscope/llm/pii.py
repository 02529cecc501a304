"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates that pass their own check are permuted within their format by a keyed Feistel
network: a value is two halves that in turn add a keyed hash of the other, modulo the half's
range, so the map is one-to-one, a key undoes it, and equal values stay equal in all documents.
Cards keep their length, separators and a right check digit; addresses stay addresses; dates stay
dates of 1900 to 2099; phone numbers keep their country code.  Mail addresses keep their domain
and get a keyed name.  Everything is DataFrame functions, one pass, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
SSN = (898, 99 * 9999)  # areas 001 to 899 but 666; groups and serials without zero
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days end with 2099-12-31
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "phone": r"(?<![\d+])\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}(?!\d)",
    "date": r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?!\d)",
}
_MARK, _SPARE = "\x01", "\x02"


def _keyed(key: str, tweak: Column, i: Column, half: Column) -> Column:
    """60 bits of a hash of key, kind, round and half."""
    text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_range: Column, right_range: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """Struct (a, b): both halves after all rounds, or before them with ``back``."""
    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if back else 1

    def step(x: Column, i: Column) -> Column:
        a, b = x["a"], x["b"]
        even = F.pmod(a + sign * _keyed(key, tweak, i, b) % left_range, left_range)
        odd = F.pmod(b + sign * _keyed(key, tweak, i, a) % right_range, right_range)
        return F.when(i % 2 == 0, F.struct(even.alias("a"), b.alias("b"))).otherwise(F.struct(a.alias("a"), odd.alias("b")))

    return F.aggregate(order, F.struct(left.cast("long").alias("a"), right.cast("long").alias("b")), step)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def permuted_digits(digits: Column, key: str, tweak: str, back: bool = False) -> Column:
    """A string of 2 to 34 digits as another of its length."""
    n, a = F.length(digits), F.floor(F.length(digits) / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    pair = feistel(F.substr(digits, F.lit(1), a), F.substr(digits, a + 1), power(a), power(n - a), key, F.concat(F.lit(tweak), n.cast("string")), back)
    return _let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), a, "0"), F.lpad(p["b"].cast("string"), n - a, "0")))


def luhn(digits: Column) -> Column:
    """Sum of a card number whose last digit is its check digit; valid where it ends in 0."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def filled(pattern: Column, digits: Column) -> Column:
    """The digits of ``pattern`` replaced in order by ``digits``."""
    chars = F.split(pattern, "")
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), lambda x, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(x["out"], F.substr(digits, x["n"] + 1, F.lit(1))).alias("out"), (x["n"] + 1).alias("n"))).otherwise(
        F.struct(F.concat(x["out"], c).alias("out"), x["n"].alias("n"))), lambda x: x["out"])


def kind_of(value: Column) -> Column:
    """Name of the kind a found value belongs to after its own check; null if it fails."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    octets = F.split(value, r"\.")
    day = _day(value)
    return F.when(F.contains(value, F.lit("@")), "email").when(F.startswith(value, F.lit("+")), "phone").when(
        value.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})$"), F.when(day.isNotNull() & day.between("1900-01-01", "2099-12-31"), "date")).when(
        value.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~value.rlike("^(000|666|9)|-00-|-0000$"), "ssn")).when(
        value.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip")).when(
        F.length(digits).between(13, 19), F.when(luhn(digits) % 10 == 0, "card"))


def _day(value: Column) -> Column:
    d = F.regexp_replace(value, "[./]", "-")
    return F.coalesce(F.try_to_timestamp(F.when(value.rlike(r"^\d{4}-"), value), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.when(d.rlike(r"-\d{4}$"), d), F.lit("dd-MM-yyyy"))).cast("date")


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """A found value's pseudonym in its own format; values that fail their check stay.  With
    ``back`` numbers and dates are restored (mail names are hashes and stay)."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    kind = kind_of(value)
    payload = permuted_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", back)
    card = _let(payload, lambda p: F.concat(p, F.pmod(10 - luhn(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    country = F.regexp_extract(value, r"^(\+\d{1,3}[ -]?(?=[( \d])|\+\d{1,3})", 1)
    country = F.when(value.rlike(r"^\+\d{1,3}[ (-]"), F.regexp_extract(value, r"^(\+\d{1,3})", 1)).otherwise(F.substring(value, 1, 2))
    rest = F.substr(value, F.length(country) + 1)
    phone = F.concat(country, filled(rest, permuted_digits(F.regexp_replace(rest, "[^0-9]", ""), key, "phone", back)))
    o = lambda i: F.get(F.split(value, r"\."), i).cast("long")
    address = _let(feistel(o(0) * 256 + o(1), o(2) * 256 + o(3), F.lit(65536), F.lit(65536), key, F.lit("ip"), back), lambda p: F.concat_ws(
        ".", *[F.shiftright(p[h], s).bitwiseAND(F.lit(255).cast("long")).cast("string") for h, s in (("a", 8), ("a", 0), ("b", 8), ("b", 0))]))
    number = F.datediff(_day(value), F.lit(FIRST_DAY).cast("date"))
    moved = _let(feistel(F.floor(number / DAYS[1]), number % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, F.lit("date"), back),
                 lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * DAYS[1] + p["b"]).cast("int")))
    separator = F.substring(value, 3, 1)
    date = F.when(value.rlike(r"^\d{4}-"), F.date_format(moved, "yyyy-MM-dd")).otherwise(F.replace(F.date_format(moved, "dd-MM-yyyy"), F.lit("-"), separator))
    mail = F.concat(F.lit("user."), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.substring_index(value, "@", 1)), 256), 1, 16), F.lit("@"), F.substring_index(value, "@", -1))
    area = digits.substr(1, 3).cast("int")
    pair = feistel(area - 1 - (area > 666).cast("int"), (digits.substr(4, 2).cast("int") - 1) * 9999 + digits.substr(6, 4).cast("int") - 1,
                   F.lit(SSN[0]), F.lit(SSN[1]), key, F.lit("ssn"), back)
    ssn = _let(pair, lambda p: F.format_string("%03d-%02d-%04d", p["a"] + 1 + (p["a"] > 664).cast("int"), F.floor(p["b"] / 9999) + 1, p["b"] % 9999 + 1))
    return F.when(kind == "card", filled(value, card)).when(kind == "phone", phone).when(kind == "ip", address).when(kind == "date", date).when(
        kind == "ssn", ssn).when(kind == "email", value if back else mail).otherwise(value)


def _replaced(text: Column, key: str, back: bool) -> Column:
    """Struct (text, n): the text with pseudonyms, and how many values passed their check."""
    safe = F.replace(F.replace(text, F.lit(_SPARE), F.lit(_SPARE + "B")), F.lit(_MARK), F.lit(_SPARE + "A"))
    # Words are scanned once for mail addresses; all other kinds begin with a digit or a plus sign.
    found = f"{KINDS['email']}|(?=[+0-9])(?:" + "|".join(p for k, p in KINDS.items() if k != "email") + ")"
    marked = F.regexp_replace(safe, found, f"{_MARK}$0{_MARK}")
    plain = lambda t: F.replace(F.replace(t, F.lit(_SPARE + "A"), F.lit(_MARK)), F.lit(_SPARE + "B"), F.lit(_SPARE))
    done = lambda parts: F.struct(
        plain(F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, pseudonym(p, key, back)).otherwise(p)), "")).alias("text"),
        F.size(F.filter(parts, lambda p, i: (i % 2 == 1) & kind_of(p).isNotNull())).cast("long").alias("n"))
    return _let(F.split(marked, _MARK), done)


def pseudonymise(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and the number of replaced values, ``n_values``.

    All rows and other columns stay as they are (a column ``n_values`` is replaced); null texts
    stay null with 0 values, empty and repeated rows are themselves, texts of any length are read
    whole.  ``back`` restores numbers and dates made with the same key.
    """
    own = docs.drop("n_values").columns
    made = docs.withColumn("n_values", _replaced(F.col("text"), key, back))
    return made.select(*[F.col("n_values.text").alias("text") if c == "text" else F.col(c) for c in own], F.coalesce("n_values.n", F.lit(0)).cast("long").alias("n_values"))
