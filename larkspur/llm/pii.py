"""Pseudonyms of personal data by keyed Feistel permutations within the format. DataFrame functions only.

What a pattern finds is validated (checksums, ranges, calendar) and then permuted under a key: digits stay digits,
letters stay letters of their case, separators stay where they are, numbers with a check digit get the right one, dates
stay dates, addresses stay addresses. A permutation is the same in every document, so equal values stay equal and
different values stay different, and without the key nothing leads back.

Numbers use a Feistel network over Z_a x Z_b with addition, whose product is exactly the number of valid values, so no
value falls outside. Texts use one over their two halves, each character shifted within its class by the digest of the
other half.

A match that fails its validation consumes nothing: its shorter forms are tried (a card up to each separator, an IBAN at
the length of its country), then the other forms at its place, then the text from its next character on.

Scale: one projection, no shuffle and no state. Texts without a digit are not searched; there is no Python. One regular
expression finds all values of a text; only texts where one of them fails validation are searched step by step, in pieces
that no value crosses.

Defined cases: a null text stays null and has no findings; what fails validation in every form and length stays as it is; values are found from
left to right and never overlap; an e-mail address keeps its domain; columns of other names pass through, one called
`pii` is replaced; repeated rows are changed alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as c

ROUNDS = 6
KEY = "change me"
# Forms of personal data, in the order in which they are tried at a place.
FORMS = {
    "secret": r"\bAKIA[A-Z0-9]{16}\b|(?i:\b(?:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_\-]{8,}",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9/\-]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
}
PATTERN = "|".join(f"(?:{x})" for x in FORMS.values())
# Places that no form crosses: after a character that no form holds, or after a line end that is not in an assignment.
PIECES = r"(?<=[,;!?<>\[\]{}|&*#$^~`])|(?<=\n)(?<![=:]\s{1,3})(?!\s{0,2}[=:])"
# Lengths of account numbers by country.
IBAN_LENGTHS = {n: lands.split() for n, lands in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items()}
_CENTURIES = "1800-01-01"  # 400 years from here are 146 097 days = 189 x 773


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _number(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("long")


def _digest(*parts: Column | str) -> Column:
    """Hex SHA-512 of the parts; lengths are kept apart by a separator that no part holds."""
    return F.sha2(F.concat_ws("\x1f", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts]), 512)


def permute_number(a: Column, b: Column, mod_a: int, mod_b: int, key: str, tag: str) -> Column:
    """Struct (a, b), a keyed permutation of the pairs below mod_a and mod_b."""
    def step(state: Column, i: Column) -> Column:
        left = F.pmod(state["a"] + _number(F.substring(_digest(key, tag, i, state["b"]), 1, 15)), F.lit(mod_a))
        return F.struct(left.alias("a"), state["b"].alias("b"))

    def other(state: Column, i: Column) -> Column:
        right = F.pmod(state["b"] + _number(F.substring(_digest(key, tag, i, state["a"]), 1, 15)), F.lit(mod_b))
        return F.struct(state["a"].alias("a"), right.alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, i: F.when(i % 2 == 1, step(s, i)).otherwise(other(s, i)))


def permute_text(text: Column, key: str, tag: str, hexadecimal: bool = False) -> Column:
    """A keyed permutation of the texts with the same classes of characters at the same places."""
    classes = [("0123456789abcdef", 16)] if hexadecimal else [("0123456789", 10), (c.LOWER, 26), (c.UPPER, 26)]

    def shift(half: Column, digest: Column) -> Column:
        def one(i: Column, own: Column) -> Column:
            char = F.substr(half, i, F.lit(1))
            by = _number(F.substr(own, F.pmod(i * 2 - 1, F.lit(126)) + 1, F.lit(2)))
            out = char
            for letters, size in reversed(classes):
                at = F.position(char, F.lit(letters))  # a class is tried only where the ones before it fail
                out = F.when(at > 0, F.substr(F.lit(letters), F.pmod(at - 1 + by, F.lit(size)).cast("int") + 1, F.lit(1))).otherwise(out)
            return out

        def all_of(own: Column) -> Column:
            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), lambda i: one(i, own)), "")

        return F.when(F.length(half) == 0, half).otherwise(let(digest, all_of))

    def step(state: Column, i: Column) -> Column:
        return (F.when(i % 2 == 1, F.struct(shift(state["a"], _digest(key, tag, i, state["b"])).alias("a"), state["b"].alias("b")))
                .otherwise(F.struct(state["a"].alias("a"), shift(state["b"], _digest(key, tag, i, state["a"])).alias("b"))))

    middle = (F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), middle).alias("a"), F.substr(text, middle + 1).alias("b"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), lambda done: F.concat(done["a"], done["b"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(form: Column, characters: Column, member: str) -> Column:
    """The form with its members replaced, in order, by the characters."""
    def one(i: Column, new: Column) -> Column:
        char = F.substr(form, i, F.lit(1))
        rank = F.length(F.regexp_replace(F.substr(form, F.lit(1), i), f"[^{member}]", ""))
        return F.when(char.rlike(f"[{member}]"), F.substr(new, rank, F.lit(1))).otherwise(char)

    return let(characters, lambda new: F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: one(i, new)), ""))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number whose last digit is its check digit."""
    def one(own: Column, total: Column, i: Column) -> Column:
        d = F.substr(own, F.length(own) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return let(digits, lambda own: F.aggregate(F.sequence(F.lit(0), F.length(own) - 1), F.lit(0), lambda total, i: one(own, total, i)))


def _mod97(account: Column) -> Column:
    """Remainder of an account number, its first four characters moved to the end and letters counted from 10."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def one(rest: Column, char: Column) -> Column:
        value = F.position(char, F.lit("0123456789" + c.UPPER)) - 1
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, char: F.when(char == "", rest).otherwise(one(rest, char)))


def _part(text: Column, group: str) -> Column:
    return F.regexp_extract(text, group, 1)


def _card(v: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(v)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permute_text(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card"))
    checked = let(body, lambda x: F.concat(x, F.pmod(10 - luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))
    return luhn_sum(digits) % 10 == 0, _refill(v, checked, "0-9")


def _iban(v: Column, key: str) -> tuple[Column, Column]:
    flat = F.replace(v, F.lit(" "), F.lit(""))
    land = F.substr(flat, F.lit(1), F.lit(2))
    check = lambda rest: F.lpad((98 - _mod97(F.concat(land, F.lit("00"), rest))).cast("string"), 2, "0")
    checked = let(permute_text(F.substr(flat, F.lit(5)), key, "iban"), lambda rest: F.concat(land, check(rest), rest))
    return _mod97(flat) == 1, _refill(v, checked, "0-9A-Z")


def _ip(v: Column, key: str) -> tuple[Column, Column]:
    parts = F.split(v, "[.]")
    n = [parts[i].try_cast("long") for i in range(4)]
    out = let(permute_number(n[0] * 256 + n[1], n[2] * 256 + n[3], 1 << 16, 1 << 16, key, "ip"), lambda got: F.concat_ws(
        ".", *[F.floor(got[half] / 256).cast("string") if high else (got[half] % 256).cast("string") for half in "ab" for high in (True, False)]))
    valid = F.greatest(*n) <= 255
    return valid, out


def _ssn(v: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substr(v, F.lit(a), F.lit(n)).try_cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    got = permute_number(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return valid, let(got, lambda g: F.concat_ws("-", pad(g["a"] + F.when(g["a"] >= 665, 2).otherwise(1), 3), pad(F.floor(g["b"] / 9999) + 1, 2), pad(g["b"] % 9999 + 1, 4)))


def _phone(v: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(v)
    last = F.substr(digits, F.length(digits) - 9)
    area, office, line = (F.substr(last, F.lit(a), F.lit(n)).try_cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    north = (F.length(digits) >= 10) & (~v.startswith("+") | v.startswith("+1")) & (area >= 200) & (office >= 200)
    got = permute_number(area - 200, (office - 200) * 10000 + line, 800, 8_000_000, key, "phone")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    renewed = let(got, lambda g: F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), (g["a"] + 200).cast("string"), pad(F.floor(g["b"] / 10000) + 200, 3), pad(g["b"] % 10000, 4)))
    # elsewhere the plan is unknown: the first two digits (country) stay
    other = F.concat(F.substr(digits, F.lit(1), F.lit(2)), permute_text(F.substr(digits, F.lit(3)), key, "phone"))
    return F.lit(True), _refill(v, F.when(north, renewed).otherwise(other), "0-9")


def _date(v: Column, key: str) -> tuple[Column, Column]:
    iso, mark = v.rlike("^[0-9]{4}"), F.substr(v, F.lit(3), F.lit(1))
    a, b, year = F.substr(v, F.lit(1), F.lit(2)), F.substr(v, F.lit(4), F.lit(2)), F.substr(v, F.lit(7), F.lit(4))
    us = (mark == "/") & (a.try_cast("int") <= 12)  # month first where that is possible, else day first
    as_iso = F.when(iso, v).when(us, F.concat_ws("-", year, a, b)).otherwise(F.concat_ws("-", year, b, a))
    day = as_iso.try_cast("date")
    n = F.date_diff(day, F.lit(_CENTURIES).cast("date"))
    got = permute_number(F.floor(n / 773), n % 773, 189, 773, key, "date")
    moved = let(got, lambda g: F.date_add(F.lit(_CENTURIES).cast("date"), (g["a"] * 773 + g["b"]).cast("int")))
    text = let(moved, lambda new: F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(us, F.date_format(new, "MM/dd/yyyy")).otherwise(F.concat_ws("", F.date_format(new, "dd"), mark, F.date_format(new, "MM"), mark, F.date_format(new, "yyyy"))))
    return day.isNotNull() & (n >= 0) & (n < 146097) & (~iso | (F.length(v) == 10)), text


def _email(v: Column, key: str) -> tuple[Column, Column]:
    at = F.position(F.lit("@"), v)
    return F.lit(True), F.concat(permute_text(F.substr(v, F.lit(1), at - 1), key, "email"), F.substr(v, at))


def _secret(v: Column, key: str) -> tuple[Column, Column]:
    value = _part(v, r"([A-Za-z0-9_\-]{8,})$")
    secret = F.when(v.startswith("AKIA"), F.concat(F.lit("AKIA"), permute_text(F.substr(v, F.lit(5)), key, "secret")))
    prefix = F.substr(v, F.lit(1), F.length(v) - F.length(value))
    as_hex = value.rlike("^[0-9a-f]+$")
    changed = F.when(as_hex, permute_text(value, key, "hex", True)).otherwise(permute_text(value, key, "secret"))
    return F.lit(True), secret.otherwise(F.concat(prefix, changed))


_CHANGE = {"secret": _secret, "email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _finding(v: Column, key: str) -> Column:
    """Struct (kind, text) for a match; the kind is null where validation fails."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), v.alias("text"))
    for name, form in reversed(FORMS.items()):
        valid, changed = _CHANGE[name](v, key)
        out = F.when(v.rlike(f"^(?:{form})$") & valid, F.struct(F.lit(name).alias("kind"), changed.alias("text"))).otherwise(out)
    return out


def _prefixes(v: Column) -> Column:
    """The value and its beginnings before a separator, longest first."""
    ends = F.filter(F.sequence(F.length(v), F.lit(1), F.lit(-1)), lambda i: (i == F.length(v)) | F.substr(v, i + 1, F.lit(1)).isin(" ", "-"))
    return F.transform(ends, lambda i: F.substr(v, F.lit(1), i))


def _first(values: Column, test) -> Column:
    return F.coalesce(F.try_element_at(F.filter(values, test), F.lit(1)), F.lit(""))


def _shorter_card(v: Column, key: str) -> Column:
    return let(_prefixes(v), lambda all_: _first(all_, lambda x: (F.length(_digits(x)) >= 13) & _card(x, key)[0]))


def _shorter_iban(v: Column, key: str) -> Column:
    """At its country's length, else whole; of a country without a known length, the longest that is valid."""
    land, flat = F.substr(v, F.lit(1), F.lit(2)), lambda x: F.replace(x, F.lit(" "), F.lit(""))
    known = F.coalesce(*[F.when(land.isin(*lands), F.lit(n)) for n, lands in IBAN_LENGTHS.items()], F.lit(0))
    valid = lambda x: (F.length(flat(x)) >= 15) & _iban(x, key)[0]
    return let(known, lambda n: let(_prefixes(v), lambda all_: F.coalesce(
        F.nullif(_first(all_, lambda x: (F.length(flat(x)) == n) & valid(x)), F.lit("")),
        _first(all_, lambda x: ((n == 0) | (x == v)) & valid(x)))))


_SHORTER = {"card": _shorter_card, "iban": _shorter_iban}


def _value_at(place: Column, key: str) -> Column:
    """Struct (kind, text, size) of the first form that is valid after the first character, which is context only; else null."""
    def tried(name: str) -> Column:
        seen = F.regexp_extract(place, f"^(?s:.)({FORMS[name]})", 1)

        def checked(v: Column) -> Column:
            valid, changed = _CHANGE[name](v, key)
            return F.when((v != "") & valid, F.struct(F.lit(name).alias("kind"), changed.alias("text"), F.length(v).alias("size")))

        shorter = _SHORTER.get(name)
        return let(seen, lambda v: let(F.when(v == "", v).otherwise(shorter(v, key)), checked) if shorter else checked(v))

    return F.coalesce(*[tried(name) for name in FORMS])


def _search(piece: Column, key: str) -> Column:
    """Array of structs (kind, text) that make up the piece; the kind is null for what stays."""
    part = lambda kind, text: F.struct(kind.alias("kind"), text.alias("text"))
    plain = lambda text: part(F.lit(None).cast("string"), text)
    state = lambda parts, rest: F.struct(parts.alias("parts"), rest.alias("rest"))

    def at_place(own: Column, before: Column, place: Column) -> Column:
        done = F.concat(own["parts"], F.array(plain(F.substr(before, F.lit(2)))))
        return let(_value_at(place, key), lambda v: F.when(
            v.isNull(), state(F.concat(done, F.array(plain(F.substr(place, F.lit(2), F.lit(1))))), F.substr(place, F.lit(2)))).otherwise(
            state(F.concat(done, F.array(part(v["kind"], v["text"]))), F.substr(place, v["size"] + 1))))

    def step(own: Column, _: Column) -> Column:
        before = F.regexp_extract(own["rest"], f"(?s)^(.+?)(?={PATTERN})", 1)
        found = let(before, lambda b: F.when(
            b == "", state(F.concat(own["parts"], F.array(plain(F.substr(own["rest"], F.lit(2))))), F.lit(""))).otherwise(
            let(F.substr(own["rest"], F.length(b)), lambda place: at_place(own, b, place))))
        return F.when(own["rest"] == "", own).otherwise(found)

    none = F.array().cast("array<struct<kind:string,text:string>>")
    steps = F.sequence(F.lit(0), F.length(piece))  # each step but the last goes on by a character at least
    return F.aggregate(steps, state(none, F.concat(F.lit("\n"), piece)), step, lambda own: own["parts"])


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """The documents with personal data in their text replaced, and a struct `pii` of the findings by kind."""
    text = F.col(text_col)
    worth = F.coalesce(text.rlike("[0-9@]|(?i:password|passwd|secret|token|api_?key)"), F.lit(False))
    found = F.when(worth, F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda v: _finding(v, key)))
    columns = [x for x in docs.columns if x != "pii"]
    staged = docs.select(F.struct(*[F.col(f"`{x}`") for x in columns]).alias("__row"), F.inline(F.array(F.struct(found.alias("__found")))))
    own = F.col("__row").getField(text_col)
    parts = F.when(F.exists("__found", lambda x: x["kind"].isNull()), F.flatten(F.transform(F.split(own, PIECES, -1), lambda piece: _search(piece, key))))
    staged = staged.select("__row", "__found", F.inline(F.array(F.struct(parts.alias("__parts")))))
    kinds = F.transform(F.coalesce("__parts", "__found"), lambda x: x["kind"])
    count = lambda k: F.coalesce(F.size(F.filter(kinds, lambda x: x == k)), F.lit(0)).cast("long")
    changed = F.when(F.col("__parts").isNotNull(), F.array_join(F.transform("__parts", lambda x: x["text"]), "")).when(
        F.col("__found").isNotNull() & (F.size("__found") > 0), _rebuild(own)).otherwise(own)
    return staged.select(
        *[changed.alias(x) if x == text_col else F.col("__row").getField(x).alias(x) for x in columns],
        F.struct(*[count(k).alias(k) for k in FORMS]).alias("pii"))


def _rebuild(text: Column) -> Column:
    between = F.split(text, PATTERN, -1)
    return F.array_join(F.zip_with(between, F.transform("__found", lambda x: x["text"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: whole documents with pseudonyms, and the findings by kind."""
    got = pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "text", *[F.col("pii").getField(k).alias(f"n_{k}") for k in FORMS])
