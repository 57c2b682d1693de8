"""Personal data under format-preserving pseudonyms: keyed Feistel permutations, in SQL expressions only.

Equal values get equal pseudonyms in every document; a pseudonym has the value's format and passes the same validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Kinds in the order in which they are tried at a place; each pattern only starts where no longer number or name is cut.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "date": r"(?<![\d/-])(?:(?:19|20)\d{2}-\d{2}-\d{2}|\d{2}/\d{2}/(?:19|20)\d{2})(?![\d/-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "phone": r"(?<![\d+(-])(?:\+\d{1,2} )?(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\d-])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"
#: Dates are days of 1900 to 2099, 17 x 4297 of them; social numbers are 898 areas x 99 groups x 9999 serials.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def _draw(key: str, kind: str, n: Column, half: Column) -> Column:
    """128 hexadecimal digits that depend on the key, the kind, the round and one half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), half.cast("string")), 512)


def _number(hexadecimal: Column, start: Column | int, length: int) -> Column:
    return F.conv(F.substr(hexadecimal, F.lit(start) if isinstance(start, int) else start, F.lit(length)), 16, 10).cast("long")


def permuted_number(x: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A permutation of 0 .. a*b - 1: a Feistel network whose halves count to a and to b."""
    state = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
    left = lambda s, n: F.struct(((s["l"] + _number(_draw(key, kind, n, s["r"]), 1, 12)) % a).alias("l"), s["r"].alias("r"))
    right = lambda s, n: F.struct(s["l"].alias("l"), ((s["r"] + _number(_draw(key, kind, -n, s["l"]), 1, 12)) % b).alias("r"))
    turns = F.sequence(F.lit(1), F.lit(2 * ROUNDS))
    return F.aggregate(turns, state, lambda s, n: F.when(n % 2 == 1, left(s, n)).otherwise(right(s, n)), lambda s: s["l"] * b + s["r"])


def permuted_string(s: Column, alphabet: str, key: str, kind: str) -> Column:
    """A permutation of the strings of s's length over `alphabet`: each round adds the hash of one half to the other."""
    size = len(alphabet)

    def shifted(half: Column, by: Column) -> Column:
        def digit(c: Column, i: Column) -> Column:
            moved = F.position(c, F.lit(alphabet)) - 1 + _number(by, 1 + 4 * (i % 32), 4)
            return F.substr(F.lit(alphabet), (moved % size + 1).cast("int"), F.lit(1))

        return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.split(half, ""), digit), ""))

    cut = F.floor(F.length(s) / 2).cast("int")
    state = F.struct(F.substr(s, F.lit(1), cut).alias("l"), F.substr(s, cut + 1, F.length(s)).alias("r"))
    left = lambda x, n: F.struct(shifted(x["l"], _draw(key, kind, n, x["r"])).alias("l"), x["r"].alias("r"))
    right = lambda x, n: F.struct(x["l"].alias("l"), shifted(x["r"], _draw(key, kind, -n, x["l"])).alias("r"))
    turns = F.sequence(F.lit(1), F.lit(2 * ROUNDS))
    return F.aggregate(turns, state, lambda x, n: F.when(n % 2 == 1, left(x, n)).otherwise(right(x, n)), lambda x: F.concat(x["l"], x["r"]))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of the digits, the last one undoubled, modulo 10."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def _refilled(shape: Column, chars: Column, filled: str) -> Column:
    """`shape` with the characters of class `filled` replaced by those of `chars`, in order."""
    place = lambda i: F.length(F.regexp_replace(F.substr(shape, F.lit(1), i + 1), f"[^{filled}]", ""))
    take = lambda c, i: F.when(c.rlike(f"[{filled}]"), F.substr(chars, place(i), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(shape, ""), take), "")


def kind_of(found: Column) -> Column:
    """The kind of a match whose content is valid; null if it is not, and then the match is left as it is."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    part = lambda at, n: F.substr(digits, F.lit(at), F.lit(n)).cast("int")
    octets = F.transform(F.split(found, "[.]"), lambda x: x.cast("int"))
    return (
        F.when(found.contains("@"), "email")
        .when(found.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.when(_day(found).isNotNull(), "date"))
        .when(found.contains("/"), F.when(_day(found).isNotNull(), "date"))
        .when(found.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(part(1, 3).between(1, 899) & (part(1, 3) != 666) & (part(4, 2) > 0) & (part(6, 4) > 0), "ssn"))
        .when(found.rlike(r"^\d{1,3}[.]"), F.when(F.forall(octets, lambda x: x < 256) & ~found.rlike(r"(?:^|[.])0\d"), "ip"))
        .when(found.rlike(r"[(+]|^\d{3}-\d{3}-"), "phone")
        .otherwise(F.when(_luhn(digits) == 0, "card"))
    )


def _day(found: Column) -> Column:
    iso = F.when(found.contains("/"), F.concat_ws("-", F.substr(found, F.lit(7), F.lit(4)), F.substr(found, F.lit(4), F.lit(2)), F.substr(found, F.lit(1), F.lit(2)))).otherwise(found)
    return F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))


def pseudonym(found: Column, kind: Column, key: str) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    part = lambda at, n: F.substr(digits, F.lit(at), F.lit(n)).cast("long")
    two = lambda x, n: F.lpad(x.cast("string"), n, "0")

    local = F.lower(F.regexp_replace(F.regexp_extract(found, "^[^@]+", 0), "[^A-Za-z0-9]", ""))
    email = F.concat(
        _refilled(F.regexp_extract(found, "^[^@]+", 0), permuted_string(local, LETTERS, key, "email"), "A-Za-z0-9"), F.regexp_extract(found, "@.*$", 0)
    )
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted_number(_day(found), *DAYS, key, "date").cast("int"))
    date = F.when(found.contains("/"), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))

    area = F.when(part(1, 3) > 666, part(1, 3) - 2).otherwise(part(1, 3) - 1)
    moved = permuted_number((area * 99 + part(4, 2) - 1) * 9999 + part(6, 4) - 1, 898 * 99, 9999, key, "ssn")
    area = F.floor(moved / (99 * 9999)).cast("long")
    group = F.floor(moved / 9999).cast("long") % 99
    ssn = F.concat_ws("-", two(F.when(area >= 665, area + 2).otherwise(area + 1), 3), two(group + 1, 2), two(moved % 9999 + 1, 4))

    octets = F.transform(F.split(found, "[.]"), lambda x: x.cast("long"))
    moved = permuted_number(F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x), 65536, 65536, key, "ip")
    ip = F.concat_ws(".", *(F.shiftright(moved, n).bitwiseAND(255).cast("string") for n in (24, 16, 8, 0)))

    own = F.regexp_replace(F.regexp_replace(found, r"^\+\d{1,2} ", ""), "[^0-9]", "")
    prefix = F.regexp_extract(found, r"^\+\d{1,2} ", 0)
    phone = F.concat(prefix, _refilled(F.regexp_replace(found, r"^\+\d{1,2} ", ""), permuted_string(own, LETTERS[:10], key, "phone"), "0-9"))

    body = permuted_string(F.substr(digits, F.lit(1), F.length(digits) - 1), LETTERS[:10], key, "card")
    card = _refilled(found, F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")), "0-9")
    made = F.when(kind == "email", email)
    for name, x in (("date", date), ("ssn", ssn), ("ip", ip), ("phone", phone), ("card", card)):
        made = made.when(kind == name, x)
    return F.coalesce(made, found)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n_email, n_date, n_ssn, n_ip, n_phone, n_card, text)` for every row, with each valid value under its pseudonym.

    E-mail names keep their length, signs and domain (upper case is not kept); cards stay Luhn-valid; dates stay between
    1900 and 2099; numbers that fail validation stay as they are. Null texts stay null and count nothing; empty texts, null
    ids, repeated rows and other columns pass through."""
    text = F.col(text_col).cast("string")
    some = text.rlike("[0-9@]")
    found = F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), found.alias("found"))
    rows = rows.withColumn("kinds", F.transform("found", kind_of))
    pieces = F.split(F.col("text"), ANY, -1)
    values = F.transform("found", lambda x, i: pseudonym(x, F.get("kinds", i), key))
    woven = F.array_join(F.flatten(F.transform(pieces, lambda p, i: F.array(p, F.coalesce(F.get(values, i), F.lit(""))))), "")
    count = lambda k: F.when(F.col("kinds").isNull(), 0).otherwise(F.size(F.filter("kinds", lambda x: x == k))).alias(f"n_{k}")
    return rows.select("doc_id", *map(count, KINDS), F.when(F.size("found") > 0, woven).otherwise(F.col("text")).alias("text"))


#: The production key is a parameter of the deployment; this one is for the registered query and the tests.
QUERY_KEY = "an example key"


def op7_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_KEY)
