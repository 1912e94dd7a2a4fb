"""Format-preserving pseudonyms by a keyed Feistel network, in SQL expressions only.

Found values are validated (Luhn sums, octet ranges, calendar dates, dialling
formats) and replaced by the value that a keyed permutation of their own
format gives.  The permutation is one-to-one and depends on the key and the
kind only, so equal values stay linked across documents, and no table of
values is kept or shuffled: the operator is one pass without any exchange.

Texts: a value is cut in two halves; in each round one half's characters are
shifted within their class (digits, lower-case, upper-case letters) by a
stream hashed from the other half.  Numbers with a range that is no power of
ten (dates, addresses) use the same network on Z_a x Z_b.

kind   kept                             permuted
card   first digit, separators          the others; the check digit is recomputed
phone  country code, first digit        the others
ipv4   first octet                      the other 24 bits
date   notation                         the day, within 1800-01-01 .. 2199-12-31
ssn    area, separators                 group 01-99 and serial 0001-9999
email  domain, punctuation              letters and digits of the local part

Letters beyond ASCII move among the 64 characters that differ in their last
byte alone.  A local part of one character has one shift for a key, since it
has no other half: such addresses hide little.

A date written a/b/yyyy is read month first where that is a date, else day
first.  Values that fail validation stay as they are.

An address is only matched if its domain is one: up to eight labels of up to 63
characters, the last of letters.  So a user name before a number, or a
second @, hides no value of another kind and no address from the search.

No pattern repeats a group without bound, and none can begin within a run that
it has tried before, so texts and values of any length take linear time and no
stack.

The key is the caller's secret: ``key``, or the session's setting
``spark.helmtrack.pii.key``.  Without either a published example key is used,
with which anyone can invert the pseudonyms.

Defined cases: a null text stays null, an empty one empty; null ids and
repeated rows give rows like any others; an empty table gives an empty result;
all other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

ROUNDS = 8
#: An example; a real one is given by the caller or by the session.
KEY = "helmtrack-pseudonyms-1"
KEY_SETTING = "spark.helmtrack.pii.key"

_LOCAL, _LABEL = r"[\p{L}\p{M}\p{N}._%+-]", r"[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}-]{0,61}[\p{L}\p{M}\p{N}])?"
EMAIL = rf"(?<!{_LOCAL}){_LOCAL}++@(?:{_LABEL}\.){{1,8}}[\p{{L}}\p{{M}}]{{2,63}}"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
ANY = "|".join((EMAIL, DATE, SSN, IPV4, PHONE, CARD))
KINDS = ("card", "phone", "ipv4", "date", "ssn", "email")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often it is used.

    Inside lambdas Spark shares no common expressions; a stream used for every
    character would be hashed for every character.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("bigint")


def _shift(half: Column, stream: Column) -> Column:
    """Shifts every digit and letter of a half within its class."""

    def one(c: Column, i: Column) -> Column:
        at = F.pmod(i, F.lit(16)).cast("int") * 4 + 1
        # sixteen amounts of 16 bits; the position is added where the stream repeats
        by = _number(F.substr(stream, at, F.lit(4))) + (i / 16).cast("int") * 7
        code = F.ascii(c)
        moved = lambda base, n: F.char((F.pmod(code - base + by, F.lit(n)) + base).cast("int"))
        raw = F.hex(c)
        last = F.hex((F.pmod(_number(F.right(raw, F.lit(2))) + by, F.lit(64)) + 128).cast("bigint"))  # a last byte is 80 to BF
        beyond = F.unhex(F.concat(F.substr(raw, F.lit(1), F.length(raw) - 2), last)).cast("string")
        within = F.when(code.between(48, 57), moved(48, 10)).when(code.between(97, 122), moved(97, 26)).when(code.between(65, 90), moved(65, 26)).otherwise(c)
        return F.when(F.octet_length(c) > 1, beyond).otherwise(within)

    return F.array_join(F.transform(F.split(half, ""), one), "")


def permute_text(value: Column, tweak: Column, key: str) -> Column:
    """Feistel network on the two halves of a text."""
    cut = (F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), cut).alias("l"), F.substr(value, cut + 1, F.length(value)).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), F.length(value).cast("string"), s["r"]), 256)
        return _let(stream, lambda x: F.struct(s["r"].alias("l"), _shift(s["l"], x).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def permute_number(value: Column, a: int, b: int, tweak: Column, key: str) -> Column:
    """Feistel network on Z_a x Z_b for a number below a * b."""
    start = F.struct((value / b).cast("bigint").alias("l"), F.pmod(value, F.lit(b)).cast("bigint").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        amount = _number(F.substr(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), s["r"].cast("string")), 256), F.lit(1), F.lit(12)))
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + amount, F.when(i % 2 == 1, F.lit(a)).otherwise(F.lit(b))).cast("bigint").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * b + s["r"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits, the last one counted once."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda s, x: s + x)


def _refill(m: Column, digits: Column) -> Column:
    """The match with its digits replaced in order."""

    def one(new: Column, c: Column, i: Column) -> Column:
        before = F.length(_digits(F.substr(m, F.lit(1), i.cast("int"))))
        return F.when(c.rlike("[0-9]"), F.substr(new, before + 1, F.lit(1))).otherwise(c)

    return _let(digits, lambda new: F.array_join(F.transform(F.split(m, ""), lambda c, i: one(new, c, i)), ""))


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    head = F.substr(d, F.lit(1), F.lit(1))
    body = F.concat(head, permute_text(F.substr(d, F.lit(2), F.length(d) - 2), F.concat(F.lit("card"), head), key))
    check = lambda b: F.pmod(10 - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, _refill(m, _let(body, lambda b: F.concat(b, check(b).cast("string")))))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    code = F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})[ .(-]", 1))
    kept = F.substr(d, F.lit(1), code + 1)
    return F.when(F.length(d).between(8, 15) | ~m.startswith("+"), _refill(m, F.concat(kept, permute_text(F.substr(d, code + 2, F.length(d)), F.concat(F.lit("phone"), kept), key))))


def _ipv4(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    value = permute_number(part[1] * 65536 + part[2] * 256 + part[3], 4096, 4096, F.concat(F.lit("ipv4"), part[0].cast("string")), key)
    octet = lambda v, by: F.pmod((v / by).cast("bigint"), F.lit(256)).cast("string")
    return F.when(F.forall(part, lambda x: x < 256), _let(value, lambda v: F.concat_ws(".", part[0].cast("string"), octet(v, 65536), octet(v, 256), octet(v, 1))))


_FIRST_DAY, _DAYS_A, _DAYS_B = "1800-01-01", 189, 773  # 189 * 773 days are 400 years


def _date(m: Column, key: str) -> Column:
    def moved(form: str) -> Column:
        first = F.lit(_FIRST_DAY).cast("date")
        new = lambda day: F.date_add(first, permute_number(F.datediff(day, first).cast("bigint"), _DAYS_A, _DAYS_B, F.lit("date"), key).cast("int"))
        day = F.when(F.regexp_extract(m, "[0-9]{4}", 0).cast("int").between(1800, 2199), F.try_to_timestamp(m, F.lit(form)).cast("date"))
        return _let(day, lambda day: F.when(day.isNotNull(), F.date_format(new(day), form)))

    slash = F.coalesce(moved("MM/dd/yyyy"), moved("dd/MM/yyyy"))
    return F.when(m.contains("-"), moved("yyyy-MM-dd")).when(m.contains("/"), slash).otherwise(moved("dd.MM.yyyy"))


def _ssn(m: Column, key: str) -> Column:
    part = F.split(m, "-")
    value = (part[1].cast("bigint") - 1) * 9999 + part[2].cast("bigint") - 1
    new = permute_number(value, 99, 9999, F.concat(F.lit("ssn"), part[0]), key)
    valid = (part[0] != "000") & (part[0] != "666") & (part[0] < "900") & (part[1] != "00") & (part[2] != "0000")
    group, serial = lambda v: ((v / 9999).cast("bigint") + 1).cast("string"), lambda v: (F.pmod(v, F.lit(9999)) + 1).cast("string")
    return F.when(valid, _let(new, lambda v: F.concat_ws("-", part[0], F.lpad(group(v), 2, "0"), F.lpad(serial(v), 4, "0"))))


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permute_text(local, F.lit("email"), key), F.substr(m, F.length(local) + 1, F.length(m)))


_MAKERS: dict[str, tuple[str, Callable[[Column, str], Column]]] = {"email": (EMAIL, _email), "date": (DATE, _date), "ssn": (SSN, _ssn), "ipv4": (IPV4, _ipv4), "phone": (PHONE, _phone), "card": (CARD, _card)}


def _replaced(m: Column, key: str) -> Column:
    """Kind and pseudonym of a match; a null kind and the match where it fails validation.

    The first kind that fits is made, and made once.
    """

    def found(name: str, pattern: str, make: Callable[[Column, str], Column]) -> Column:
        whole = m.contains("@") if name == "email" else m.rlike(f"^(?:{pattern})$")
        return _let(F.when(whole, make(m, key)), lambda v: F.when(v.isNotNull(), F.struct(F.lit(name).alias("kind"), v.alias("value"))))

    none = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))
    return F.coalesce(*[found(name, *x) for name, x in _MAKERS.items()], none)


def pseudonymise(docs: DataFrame, *, text: str = "text", key: str = KEY) -> DataFrame:
    """All columns, the text with pseudonyms, and ``pii``: an array of the kinds replaced, in text order."""
    columns = docs.columns
    t = F.col("row")[text]
    some = t.rlike("[0-9@]")
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"))
    found = rows.withColumn("found", F.when(some, F.transform(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), lambda m: _replaced(m, key))))
    joined = F.array_join(F.zip_with(F.split(t, ANY, -1), F.col("found"), lambda gap, f: F.concat(gap, F.coalesce(f["value"], F.lit("")))), "")
    new = F.when(F.size("found") > 0, joined).otherwise(t)
    kinds = F.filter(F.coalesce(F.transform("found", lambda f: f["kind"]), F.array().cast("array<string>")), lambda k: k.isNotNull())
    return found.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in columns], kinds.alias("pii"))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or KEY


def pii(spark: SparkSession, sf_dir: str, *, key: str | None = None) -> DataFrame:
    """op3: doc_id, the text with pseudonyms, and counts by kind."""
    out = pseudonymise(tx.table(spark, sf_dir, "documents").select("doc_id", "text"), key=key or session_key(spark))
    counts = [(F.size("pii") - F.size(F.array_remove("pii", name))).cast("bigint").alias(f"n_{name}") for name in KINDS]
    return out.select("doc_id", "text", F.size("pii").cast("bigint").alias("n_pii"), *counts)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, *, key: str | None = None) -> DataFrame:
    """Pipeline stage: the documents with pseudonyms in their texts."""
    return pseudonymise(docs, key=key or session_key(spark)).select(*docs.columns)
