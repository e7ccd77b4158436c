"""Format-preserving Feistel pseudonyms, with DataFrame functions only.

One pattern finds candidates; each is validated by its kind (Luhn sum, octet range, calendar, IBAN remainder, phone and
number shape) and what fails is left as it is. A valid value's canonical form is permuted within its own format, so that
check sums, calendars and octets hold again, the pseudonym is found as the same kind again, and equal values get equal
pseudonyms in all documents, whatever their separators. Separators, case, lengths and country or dialling prefixes stay.

The permutation is a keyed Feistel network, a keyed step that moves every value (its first character, or its first number,
by more than nothing), and the network backwards. A conjugate of a permutation without fixed points has none, so no value
is its own pseudonym.

* characters (cards, phones, bank accounts, mail names, secret hexadecimal tokens of 16 or more, access key ids after their
  four-letter prefix): each half's digits and letters move, modulo their alphabet's size, by a hash of the key, the round,
  their place and the other half. Which places of a token hold letters stays, so that it is a token again;
* mail names may have any letters: Latin, Greek and Cyrillic ones move within their alphabets; a name with others (or with
  combining marks) is replaced by Latin letters hashed from the whole name, which links it too but is no permutation;
* social security numbers: the 898 areas in use, and group and serial number without zeros, as a pair modulo 898 and 989,901;
* IPv4: two 16-bit halves; dates: days of a 400-year cycle (1700 to 2099, and so on from 0100 to 9699), as a pair modulo
  189 and 773 (189 * 773 = 146,097 days); the years before 0100 and from 9700 on are two shorter cycles. A date with slashes
  is month first, or day first where that is no date, and keeps its order.

It is one narrow stage: no shuffle, no join, nothing that grows with the data but the rows themselves, so skew and copies
do not matter. Documents without a digit, an at sign or an access key prefix are passed on after one simple scan. There is no default key: it is an
argument, and `run_key` reads it from spark.quillspark.pseudonym.key. It is part of the plan, so event logs need the same care.

Defined results: a null text stays null with counts of zero; an empty text stays empty; a text of any length is read whole,
and so are tokens and mail names of any length; ties and repeated rows give equal results; other columns pass through
unchanged (`pii_report` ignores them); an empty table gives an empty table. A mail name without letter and digit is no name.
"""

from __future__ import annotations

import secrets
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import fresh

ROUNDS, KEY_SETTING = 8, "spark.quillspark.pseudonym.key"

# Patterns by kind, tried in this order.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{M}\p{N}._%+-]*+@(?:[\p{L}\p{M}\p{N}-]{1,63}\.){1,126}\p{L}{2,63}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z]{4})?(?: [0-9]{4}){2,7}(?: [0-9]{1,3})?)(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:(?=[0-9]*+[a-f])[0-9a-f]{16,}+|(?=[0-9A-F]{4}[0-9]*+[A-F])[0-9A-F]{16,}+|A[KS]IA[A-Z0-9]{16})(?![\p{L}\p{N}])",
    "date": r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![\p{L}\p{N}/-]|\.[0-9])",
    "ip": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}]|-[0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![\p{L}\p{N}])",
}
KINDS = list(PATTERNS)
ANY = "|".join(PATTERNS.values())
#: First day and length of the cycle of dates; first day and pair of the shorter ones at both ends.
CYCLE_START, CYCLE_DAYS, CYCLE = "1700-01-01", 146097, (189, 773)
EARLY, LATE = ("0001-01-01", (51, 709)), ("9700-01-01", (276, 397))


def _letters(first: int, last: int, lower: bool) -> str:
    return "".join(c for c in map(chr, range(first, last + 1)) if (c.islower() if lower else c.isupper()))


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN, HEX = [DIGITS, LOWER, UPPER], [DIGITS, "abcdef", "ABCDEF"]
#: The letters of the Latin, Greek and Cyrillic blocks besides a to z, by case.
NAMES = PLAIN + [_letters(first, last, lower) for first, last in ((0xC0, 0x24F), (0x386, 0x3CE), (0x400, 0x45F)) for lower in (True, False)]


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != F.lit(""))


def _hash(key: str, kind: Column, round_: Column, *rest: Column) -> Column:
    """A keyed number below 2**48."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, round_.cast("string"), *[r.cast("string") for r in rest]), 256), 1, 12), 16, 10).cast("long")


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _alphabets(sets: list[str]) -> Column:
    return F.expr("split('" + "|".join(sets) + "', '[|]')")


def _shifted(c: Column, by, sets: Column) -> Column:
    """A character moved within its alphabet by `by`, a function of the alphabet's size; one in none of them stays."""
    own = F.filter(sets, lambda letters: F.call_function("locate", c, letters) > 0)
    moved = lambda letters: F.substr(letters, F.pmod(F.call_function("locate", c, letters) - 1 + by(F.length(letters)), F.length(letters)).cast("int") + 1, F.lit(1))
    return F.coalesce(F.get(F.transform(own, moved), F.lit(0)), c)


def _short(s: Column) -> Column:
    """What stands for a string in hashes: a long one is hashed once, not for each character that it moves."""
    return F.when(F.length(s) > 64, F.sha2(s, 256)).otherwise(s)


def _moved(half: Column, other: Column, key: str, kind: Column, round_: Column, sign: Column, sets: Column) -> Column:
    """Each digit and letter of `half` moved within its alphabet, by what `other` says."""
    one = lambda c, i, o: _shifted(c, lambda _: sign * _hash(key, kind, round_, i, o), sets)
    return _let(_short(other), lambda o: F.array_join(F.transform(_chars(half), lambda c, i: one(c, i, o)), ""))


def _steps() -> Column:
    """The rounds, 0 for the step between, and the rounds backwards."""
    return F.expr("array(" + ", ".join(map(str, (*range(1, ROUNDS + 1), 0, *range(-ROUNDS, 0)))) + ")")


def _permuted(text: Column, key: str, kind: Column, sets: Column) -> Column:
    """The characters of `sets` permuted in their format, none of the results as before; the others stay in their places."""
    cut = F.ceil(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), cut).alias("a"), F.substr(text, cut + 1, F.length(text)).alias("b"))
    step = _hash(key, kind, F.lit(0))

    def middle(s: Column) -> Column:
        """The first digit or letter moves by 1 or more, less than its alphabet's size. It may stand in either half."""
        moved = _let(F.concat(s["a"], s["b"]), lambda whole: _let(F.length(F.regexp_extract(whole, r"^[^\p{L}\p{N}]*", 0)), lambda k: F.concat(F.substr(whole, F.lit(1), k), _shifted(F.substr(whole, k + 1, F.lit(1)), lambda n: F.lit(1) + F.pmod(step, n - 1), sets), F.substr(whole, k + 2, F.length(whole)))))
        half = F.length(s["a"])
        return _let(moved, lambda m: F.struct(F.substr(m, F.lit(1), half).alias("a"), F.substr(m, half + 1, F.length(m)).alias("b")))

    def turn(s: Column, r: Column) -> Column:
        """The half that moves is the first in odd rounds; to write it once, the halves change places around it."""
        n, sign = F.abs(r), F.signum(r).cast("int")
        odd = F.pmod(n, F.lit(2)) == 1
        moves, other = F.when(odd, s["a"]).otherwise(s["b"]), F.when(odd, s["b"]).otherwise(s["a"])
        there = _let(_moved(moves, other, key, kind, n, sign, sets), lambda m: F.struct(F.when(odd, m).otherwise(s["a"]).alias("a"), F.when(odd, s["b"]).otherwise(m).alias("b")))
        return F.when(r == 0, middle(s)).otherwise(there)

    return F.aggregate(_steps(), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _permuted_pair(pair: Column, key: str, kind: Column) -> Column:
    """A struct of numbers a below n and b below m, permuted, never to itself."""

    def turn(s: Column, r: Column) -> Column:
        odd = F.pmod(r, F.lit(2)) == 1
        by = F.signum(r) * _hash(key, kind, F.abs(r), F.when(odd, s["b"]).otherwise(s["a"]))
        a = F.when(r == 0, s["a"] + 1 + F.pmod(_hash(key, kind, F.lit(0)), s["n"] - 1)).when(odd, s["a"] + by.cast("long")).otherwise(s["a"])
        b = F.when((r == 0) | odd, s["b"]).otherwise(s["b"] + by.cast("long"))
        return F.struct(F.pmod(a, s["n"]).alias("a"), F.pmod(b, s["m"]).alias("b"), s["n"].alias("n"), s["m"].alias("m"))

    return F.aggregate(_steps(), pair, turn)


def _pair(a: Column, b: Column, n: Column, m: Column) -> Column:
    return F.struct(*[x.cast("long").alias(name) for x, name in ((a, "a"), (b, "b"), (n, "n"), (m, "m"))])


def _refill(original: Column, new: Column) -> Column:
    """`original` with its digits and letters replaced by those of `new`, in order."""
    place = lambda i: F.length(_plain(F.substr(original, F.lit(1), i + 1)))
    return F.array_join(F.transform(_chars(original), lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(new, place(i), F.lit(1))).otherwise(c)), "")


def _plain(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9]", "")


def _luhn(digits: Column, first_doubled: int) -> Column:
    """Sum of digits from the right; every other one, from place `first_doubled` on (0 or 1), is doubled."""
    each = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(F.pmod(i, F.lit(2)) == first_doubled, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _mod97(text: Column) -> Column:
    """Remainder of an account's characters, letters as 10 to 35."""
    value = lambda c: F.call_function("locate", c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1
    return F.aggregate(_chars(text), F.lit(0), lambda s, c: F.pmod(s * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)).cast("int"))


def _date(m: Column) -> Column:
    parts = lambda pattern, fmt: F.when(m.rlike(pattern), F.try_to_date(m, fmt))
    iso, dots, slashes = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
    return F.coalesce(parts(iso, "yyyy-MM-dd"), parts(dots, "d.M.yyyy"), parts(slashes, "M/d/yyyy"), parts(slashes, "d/M/yyyy"))


def _octet(m: Column, i: int) -> Column:
    return F.element_at(F.split(m, r"\."), i).cast("int")


def _kind(m: Column) -> Column:
    """The kind whose pattern took the candidate, if it is valid, else null."""
    digits = _plain(m)
    account = F.concat(F.substr(digits, F.lit(5), F.length(digits)), F.substr(digits, F.lit(1), F.lit(4)))
    is_account = m.rlike("^[A-Z]{2}[0-9]{2}") & F.length(digits).between(15, 34) & (_mod97(account) == 1)
    rules = [
        ("email", m.contains("@"), F.substring_index(m, "@", 1).rlike(r"[\p{L}\p{N}]")),
        ("iban", is_account, F.lit(True)),
        ("secret", m.rlike("^(?:(?=[0-9]*[a-f])[0-9a-f]{16,}|(?=[0-9A-F]{4}[0-9]*[A-F])[0-9A-F]{16,}|A[KS]IA[A-Z0-9]{16})$"), m.rlike("^A[KS]IA") | m.rlike("[0-9]") & m.rlike("[A-Fa-f]")),
        ("iban", m.rlike("^[A-Z]{2}[0-9]{2}"), F.lit(False)),
        ("date", m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})$"), _date(m).between(F.lit(EARLY[0]).cast("date"), F.lit("9999-12-31").cast("date"))),
        ("ip", m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), F.greatest(*[_octet(m, i) for i in range(1, 5)]) <= 255),
        ("ssn", m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ~m.rlike("^(?:000|666|9)|-00-|-0000$")),
        ("card", m.rlike("^[0-9](?:[ -]?[0-9]){12,18}$"), (F.length(digits).between(13, 19)) & (F.pmod(_luhn(digits, 1), F.lit(10)) == 0)),
        ("phone", F.lit(True), F.length(digits).between(10, 15)),
    ]
    out = None
    for kind, is_it, valid in rules:
        value = F.when(valid, kind)
        out = F.when(is_it, value) if out is None else out.when(is_it, value)
    return out


CHARACTERS, NUMBERS = ["card", "iban", "phone", "email", "secret"], ["ip", "ssn", "date"]


def _of_characters(kind: Column, m: Column, key: str) -> Column:
    digits, n = _plain(m), F.length(m)
    name, access = F.substring_index(m, "@", 1), m.rlike("^A[KS]IA")
    rest = F.substr(digits, F.lit(5), F.length(digits))  # of an account: without country and check digits
    prefix = F.length(digits) - 10  # dialling prefix; the last ten digits are a phone's canonical form
    moved = (
        F.when(kind == "card", F.substr(digits, F.lit(1), F.length(digits) - 1))
        .when(kind == "iban", rest)
        .when(kind == "phone", F.substr(digits, prefix + 1, F.lit(10)))
        .when(kind == "email", name)
        .when(access, F.substr(m, F.lit(5), n))
        .otherwise(m)
    )
    label = F.when((kind == "secret") & access, F.lit("access key")).otherwise(kind)
    sets = F.when(kind == "email", _alphabets(NAMES)).when((kind == "secret") & ~access, _alphabets(HEX)).otherwise(_alphabets(PLAIN))

    def done(new: Column) -> Column:
        check = F.pmod(10 - F.pmod(_luhn(new, 0), F.lit(10)), F.lit(10)).cast("int").cast("string")
        country = F.substr(digits, F.lit(1), F.lit(2))
        account = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        filled = F.when(kind == "card", F.concat(new, check)).when(kind == "iban", F.concat(country, account, new)).otherwise(F.concat(F.substr(digits, F.lit(1), prefix), new))
        return F.when(kind.isin("card", "iban", "phone"), _refill(m, filled)).when(kind == "email", F.concat(new, F.substr(m, F.length(name) + 1, n))).when(access, F.concat(F.substr(m, F.lit(1), F.lit(4)), new)).otherwise(new)

    # A mail name with letters of no alphabet: each character but the marks becomes a letter hashed from the whole name.
    letter = lambda i, o: F.substr(F.lit(LOWER), F.pmod(_hash(key, F.lit("name"), F.lit(0), i, o), F.lit(26)).cast("int") + 1, F.lit(1))
    hashed = _let(_short(name), lambda o: F.array_join(F.transform(_chars(name), lambda c, i: F.when(c.rlike("[._%+-]"), c).otherwise(letter(i, o))), ""))
    strange = (kind == "email") & (F.translate(name, "".join(NAMES) + "._%+-", "") != "")
    return F.when(strange, F.concat(hashed, F.substr(m, F.length(name) + 1, n))).otherwise(_let(_permuted(moved, key, label, sets), done))


def _of_numbers(kind: Column, m: Column, key: str) -> Column:
    first = lambda d: F.lit(d).cast("date")
    digits = _plain(m)
    part = lambda i, k: F.substr(digits, F.lit(i), F.lit(k)).cast("int")
    area = part(1, 3)

    def worked(d: Column) -> Column:  # d: the date, the first day of its cycle, the cycle's pair
        day = F.datediff(d["day"], d["start"])
        pair = (
            F.when(kind == "ip", _pair(_octet(m, 1) * 256 + _octet(m, 2), _octet(m, 3) * 256 + _octet(m, 4), F.lit(65536), F.lit(65536)))
            .when(kind == "ssn", _pair(area - F.when(area > 666, 2).otherwise(1), (part(4, 2) - 1) * 9999 + part(6, 4) - 1, F.lit(898), F.lit(989901)))
            .otherwise(_pair(F.floor(day / d["m"]), F.pmod(day, d["m"]), d["n"], d["m"]))
        )
        return _let(_permuted_pair(pair, key, kind), lambda s: F.when(kind == "ip", ip(s)).when(kind == "ssn", ssn(s)).otherwise(_let(F.date_add(d["start"], (s["a"] * s["m"] + s["b"]).cast("int")), form)))

    def ip(s: Column) -> Column:
        return F.concat_ws(".", *[x.cast("int").cast("string") for v in (s["a"], s["b"]) for x in (F.floor(v / 256), F.pmod(v, F.lit(256)))])

    def ssn(s: Column) -> Column:
        padded = lambda x, k: F.lpad(x.cast("string"), k, "0")
        return F.concat_ws("-", padded(s["a"] + F.when(s["a"] >= 665, 2).otherwise(1), 3), padded(F.floor(s["b"] / 9999) + 1, 2), padded(F.pmod(s["b"], F.lit(9999)) + 1, 4))

    def form(d: Column) -> Column:
        day_first = m.contains("/") & F.try_to_date(m, "M/d/yyyy").isNull()
        padded = m.rlike("^0|^[0-9]{2}[./]0|^[0-9]{2}[./][0-9]{2}[./]")
        return (
            F.when(m.contains("-"), F.date_format(d, "yyyy-MM-dd"))
            .when(m.contains(".") & padded, F.date_format(d, "dd.MM.yyyy"))
            .when(m.contains("."), F.date_format(d, "d.M.yyyy"))
            .when(day_first & padded, F.date_format(d, "dd/MM/yyyy"))
            .when(day_first, F.date_format(d, "d/M/yyyy"))
            .when(padded, F.date_format(d, "MM/dd/yyyy"))
            .otherwise(F.date_format(d, "M/d/yyyy"))
        )

    def cycle(d: Column) -> Column:
        early, late = d < first("0100-01-01"), d >= first(LATE[0])
        of = lambda x, y, z: F.when(early, x).when(late, y).otherwise(z)
        start = of(first(EARLY[0]), first(LATE[0]), F.date_add(first(CYCLE_START), (F.floor(F.datediff(d, first(CYCLE_START)) / CYCLE_DAYS) * CYCLE_DAYS).cast("int")))
        return F.struct(d.alias("day"), start.alias("start"), *[of(*[F.lit(pair[k]) for pair in (EARLY[1], LATE[1], CYCLE)]).alias(name) for k, name in enumerate("nm")])

    return _let(_let(F.when(kind == "date", _date(m)), cycle), worked)


def _pseudonym(kind: Column, m: Column, key: str) -> Column:
    return F.when(kind.isin(*CHARACTERS), _of_characters(kind, m, key)).when(kind.isin(*NUMBERS), _of_numbers(kind, m, key)).otherwise(m)


@lru_cache(maxsize=1)
def _drawn() -> str:
    return secrets.token_hex(32)


def run_key(spark: SparkSession) -> str:
    """The key in the session's settings; without one, a key drawn for this driver: links then hold within its results only."""
    return spark.conf.get(KEY_SETTING, None) or _drawn()


def _worked(docs: DataFrame, key: str) -> tuple[DataFrame, str, str]:
    """The table with two more columns, and their names: the kinds of the valid finds, and the text with pseudonyms."""
    finds_name, kinds_name, new_name = (fresh(n, docs) for n in ("_finds", "_kinds", "_new"))
    text = F.col("text").cast("string")
    found = F.when(text.rlike("[0-9@]|A[KS]IA"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    finds = F.transform(found, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))
    with_finds = docs.withColumn(finds_name, finds)
    some = F.exists(finds_name, lambda f: f["kind"].isNotNull())
    new = F.transform(finds_name, lambda f: _pseudonym(f["kind"], f["m"], key))
    woven = F.array_join(F.zip_with(F.split(text, ANY, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = with_finds.withColumn(new_name, F.when(some, woven).otherwise(text)).withColumn(kinds_name, F.filter(F.transform(finds_name, lambda f: f["kind"]), lambda k: k.isNotNull()))
    return out, kinds_name, new_name


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The same rows and columns; text with pseudonyms."""
    out, _, new = _worked(docs, key)
    return out.select(*[F.col(new).alias("text") if c == "text" else F.col(c) for c in docs.columns])


def pii_report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_pii, and a count for each kind."""
    out, kinds, new = _worked(docs.select("doc_id", "text"), key)
    of = lambda k: F.coalesce(F.size(F.filter(kinds, lambda x: x == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", F.col(new).alias("text"), F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias("n_pii"), *[of(k) for k in KINDS])
