"""Format-preserving pseudonyms for personal numbers, dates and addresses, as Column expressions alone.

Each match is validated (Luhn, mod 97, calendar, octets, assigned ranges) and its value permuted by a
keyed Feistel network on its own domain, so the pseudonym has the same format and validity, and equal
values get equal pseudonyms in every document. Card numbers keep a right check digit, IBANs right check
digits, social security numbers an assigned shape, dates stay real days of the same century.

Kinds: card (13-19 digits, Luhn; where other numbers stand around it, an issuer's first digit and groups of
four or more tell it from them), iban, ssn (ddd-dd-dddd), phone (international, or national with
brackets or parts by - or .), ipv4, email (the local part; the domain stays), date (yyyy-mm-dd, dd.mm.yyyy,
mm/dd/yyyy, dd/mm/yyyy where it can't be the former) and secret (32 or more hexadecimal digits of one
letter case after key, token, secret or password, and : or =). A number that fails its validation stays as it is.

Defined results: a null text stays null with no pseudonyms; an empty text stays empty; null ids and
repeated rows are kept; equal values stay equal across rows; an empty table gives an empty result; other
columns are ignored. Columns: doc_id, text, n_pseudonyms, kinds (sorted, comma-joined).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text

ROUNDS = 10

#: Countries by the length of their IBANs.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_BOUNDED = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
_NATIONAL = r"(?<![\p{L}\p{N}+.-])[2-9][0-9]{2}(?:-[0-9]{3}-|\.[0-9]{3}\.)[0-9]{4}(?![\p{L}\p{N}-]|\.[0-9])"
# Shapes of the candidates; validation decides. Each begins and ends where no word goes on.
SHAPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": rf"(?<![\p{{L}}\p{{N}}])(?:{_BOUNDED}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![\p{{L}}\p{{N}}])",
    "secret": r"(?i:(?<=(?:\b|_|api|access|auth|secret)(?:key|token|secret|password)[ \"']{0,2}[:=][ \"']{0,2}))(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}])",
    "date": r"(?<![\p{L}\p{N}./-])(?:[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[1-9][0-9]{3}|[0-9]{2}/[0-9]{2}/[1-9][0-9]{3})(?![\p{L}\p{N}/-])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "ipv4": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\p{L}\p{N}])|" + _NATIONAL,
}
# A whole run of digit groups, in which _cards() looks; possessive, so that long runs need no stack. It ends
# before what has a shape of its own.
_WORD = r"[0-9]++(?:-[0-9]++)*+(?![\p{L}\p{N}-])"
SHAPES["card"] = rf"(?<![\p{{L}}\p{{N}}.-])(?=[0-9](?:[ -]?[0-9]){{12}}){_WORD}(?: (?!{SHAPES['date']}|{SHAPES['ssn']}|{SHAPES['ipv4']}|{_NATIONAL}){_WORD})*+"
ANY = "|".join(f"(?:{p})" for p in SHAPES.values())
_LOWER, _UPPER, _LATIN = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
DECIMAL = ["0123456789", _LOWER, _UPPER, _LATIN]
HEX = ["0123456789abcdef"]
HEX_UPPER = ["0123456789ABCDEF"]


def _prf(key: str, kind: str, turn: Column, value: Column) -> Column:
    """60 bits of a keyed hash of a round and a half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of [0, a) x [0, b): struct l, r. Halves of unequal size take turns."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, l).otherwise((l + F.pmod(_prf(key, kind, i, r), a)) % a).alias("l"),
            F.when(odd, (r + F.pmod(_prf(key, kind, i, l), b)) % b).otherwise(r).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _ten(n: Column) -> Column:
    """10 to the n, for n up to 18."""
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n.cast("int"))).cast("long")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits to another of the same length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    s = feistel(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, v), _ten(u), _ten(v), key, kind)
    return F.transform(F.array(s), lambda x: F.concat(F.lpad(x["l"].cast("string"), u, "0"), F.lpad(x["r"].cast("string"), v, "0")))[0]


def _shift(half: Column, other: Column, turn: Column, key: str, kind: str, classes: list[str]) -> Column:
    """Each character of half moved within its class by a byte of the hash of the other half."""

    def one(c: Column, i: Column) -> Column:
        block = F.floor(i / 64)
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), block.cast("string"), other), 512)
        byte = F.conv(F.substring(stream, (i % 64 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        out = c
        for k in classes:
            at = F.instr(F.lit(k), c)
            out = F.when(at > 0, F.substring(F.lit(k), ((at - 1 + byte) % len(k) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")


def permute_chars(text: Column, key: str, kind: str, classes: list[str]) -> Column:
    """A string to another with the same classes of characters in the same places."""
    n = F.length(text)
    u = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), u).alias("l"), F.substring(text, u + 1, n - u).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, s["l"]).otherwise(_shift(s["l"], s["r"], i, key, kind, classes)).alias("l"),
            F.when(odd, _shift(s["r"], s["l"], i, key, kind, classes)).otherwise(s["r"]).alias("r"),
        )

    return F.transform(F.array(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)), lambda x: F.concat(x["l"], x["r"]))[0]


def _luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum of a digit string, from its right end."""
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    at = 0 if doubled_first else 1
    return F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == at, F.floor(x * 2 / 10) + x * 2 % 10).otherwise(x).cast("int")), F.lit(0), lambda s, x: s + x)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced, in order, by those of a string of as many."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(chars, start, step, lambda s: s["out"])


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    new = F.transform(F.array(permute_digits(body, key, "card")), lambda b: F.concat(b, ((10 - _luhn_sum(b, True) % 10) % 10).cast("string")))[0]
    return F.when((_luhn_sum(digits, False) % 10 == 0) & (F.length(F.regexp_replace(digits, digits.substr(1, 1), "")) > 0), _refill(m, new))


def _cards(m: Column, key: str) -> Column:
    """struct (out, n): m with its n cards replaced; out is null where there is none. The whole run counts first,
    then from each group the longest that looks like a card."""

    def search(parts: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            span = lambda n: F.array_join(F.slice(parts, i + 1, n), "")
            tries = F.transform(F.sequence(F.lit(5), F.lit(1)), lambda n: F.struct(n.alias("n"), F.regexp_replace(span(n), "[ -]$", "").alias("t")))
            fit = F.filter(tries, lambda x: x["t"].rlike("^(?:[0-9]{4,}[ -])*[0-9]+$") & F.length(_digits(x["t"])).between(13, 19) & (i + x["n"] <= F.size(parts)))
            made = F.filter(F.transform(fit, lambda x: F.struct(x["n"].alias("n"), _card(x["t"], key).alias("v"))), lambda x: x["v"].isNotNull())
            plain = F.struct(F.concat(s["out"], F.get(parts, i)).alias("out"), s["n"].alias("n"), s["skip"].alias("skip"))
            best = lambda b: F.when(b.isNull(), plain).otherwise(F.struct(F.concat(s["out"], b["v"], F.regexp_extract(F.get(parts, i + b["n"] - 1), "[ -]?$", 0)).alias("out"), (s["n"] + 1).alias("n"), (i + b["n"]).alias("skip")))
            starts = F.get(parts, i).rlike("^(?:[3-6]|2[2-7])[0-9]{2}")
            return F.when(i < s["skip"], s).when(~starts, plain).otherwise(F.transform(F.array(F.get(made, F.lit(0))), best)[0])

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(0).alias("skip"))
        return F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), start, step, lambda s: F.struct(F.when(s["n"] > 0, s["out"]).alias("out"), s["n"].alias("n")))

    within = F.transform(F.array(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0))), search)[0]
    whole = F.when(F.length(_digits(m)).between(13, 19), _card(m, key))
    return F.transform(F.array(whole), lambda w: F.when(w.isNotNull(), F.struct(w.alias("out"), F.lit(1).alias("n"))).otherwise(within))[0]


def _mod97(text: Column) -> Column:
    """Remainder by 97 of letters and digits, a letter counting as 10 to 35."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda s, c: ((s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("int"))


def _iban(m: Column, key: str) -> Column:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    country, bban = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))
    made = F.transform(F.array(permute_chars(bban, key, "iban", DECIMAL[:3])), lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))[0]
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    spaced = F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda s, c: F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substring(made, s["at"] + 1, F.lit(1)))).alias("out"), (s["at"] + (c != " ").cast("int")).alias("at")), lambda s: s["out"])
    return F.when(F.length(flat).between(15, 34) & (_mod97(F.concat(bban, F.substring(flat, 1, 4))) == 1), spaced)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    l = area - 1 - (area > 666).cast("int")
    r = (group - 1) * 9999 + serial - 1
    s = feistel(l, r, F.lit(898), F.lit(99 * 9999), key, "ssn")
    out = F.transform(F.array(s), lambda x: F.concat_ws("-", F.lpad((x["l"] + 1 + (x["l"] >= 665).cast("int")).cast("string"), 3, "0"), F.lpad((F.floor(x["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((x["r"] % 9999 + 1).cast("string"), 4, "0")))[0]
    return F.when(valid, out)


def _ipv4(m: Column, key: str) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(i)).cast("int") for i in (1, 2, 3, 4)]
    valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
    s = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ipv4")
    return F.when(valid, F.transform(F.array(s), lambda x: F.concat_ws(".", *(y.cast("int").cast("string") for y in (F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256))))[0])


def _date(m: Column, key: str) -> Column:
    iso, dotted = m.substr(5, 1) == "-", m.substr(3, 1) == "."
    a, b = m.substr(1, 2), m.substr(4, 2)
    year = F.when(iso, m.substr(1, 4)).otherwise(m.substr(7, 4))
    us = ~iso & ~dotted & (a.cast("int") <= 12)
    month = F.when(iso, m.substr(6, 2)).when(us, a).otherwise(b)
    day = F.when(iso, m.substr(9, 2)).when(us, b).otherwise(a)
    date = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    first = F.make_date((F.floor(year.cast("int") / 100) * 100).cast("int"), F.lit(1), F.lit(1))
    # days in a century factor without remainder: 36525 = 75 * 487 and 36524 = 92 * 397
    leap = F.floor(year.cast("int") / 100) % 4 == 0
    x, y = F.when(leap, 75).otherwise(92), F.when(leap, 487).otherwise(397)
    at = F.datediff(date, first)
    s = feistel(F.floor(at / y), at % y, x, y, key, "date")
    new = F.transform(F.array(s), lambda z: F.date_add(first, (z["l"] * y + z["r"]).cast("int")))[0]

    def shown(d: Column) -> Column:
        yy, mm, dd = (F.lpad(f(d).cast("string"), n, "0") for f, n in ((F.year, 4), (F.month, 2), (F.day, 2)))
        return F.when(iso, F.concat_ws("-", yy, mm, dd)).when(dotted, F.concat_ws(".", dd, mm, yy)).when(us, F.concat_ws("/", mm, dd, yy)).otherwise(F.concat_ws("/", dd, mm, yy))

    return F.when(date.isNotNull(), F.transform(F.array(new), shown)[0])


def _phone(m: Column, key: str) -> Column:
    prefix = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(prefix) + 1, F.length(m))
    digits = _digits(rest)
    return F.when(F.length(_digits(m)).between(7, 15) & (F.length(digits) >= 2), F.concat(prefix, _refill(rest, permute_digits(digits, key, "phone"))))


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_chars(F.substring(m, F.lit(1), at - 1), key, "email", DECIMAL), F.substring(m, at, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    lower, upper = permute_chars(m, key, "secret", HEX), permute_chars(m, key, "secret", HEX_UPPER)
    return F.when(m.rlike("[A-F]"), upper).otherwise(lower)


def _kind(m: Column) -> Column:
    tests = [("email", m.contains("@")), ("secret", m.rlike("^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})$")), ("iban", m.rlike("^[A-Z]")), ("ssn", m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), ("ipv4", m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")), ("date", m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})$")), ("phone", m.rlike(r"[+()]|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$"))]
    out = F.lit("card")
    for name, test in reversed(tests):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


_MAKERS = {"email": _email, "iban": _iban, "secret": _secret, "ssn": _ssn, "ipv4": _ipv4, "date": _date, "phone": _phone}


def pseudonym(m: Column, key: str) -> Column:
    """struct (value, kind, n) of one candidate, n values of which are replaced; value is null where validation fails."""

    def made(k: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, maker in _MAKERS.items():
            out = F.when(k == name, maker(m, key)).otherwise(out)
        one = F.struct(out.alias("value"), k.alias("kind"), F.lit(1).alias("n"))
        cards = lambda c: F.struct(c["out"].alias("value"), k.alias("kind"), c["n"].alias("n"))
        return F.when(k == "card", F.transform(F.array(_cards(m, key)), cards)[0]).otherwise(one)

    return F.transform(F.array(_kind(m)), made)[0]


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    some = ids_and_text(docs, id_col, text_col)
    # every shape holds a digit or an @: most texts need no more than this test
    has = F.col("text").rlike("[0-9@]") & F.col("text").rlike(ANY)
    found = some.withColumn("m", F.when(has, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    made = found.withColumn("p", F.transform("m", lambda m: pseudonym(m, key)))
    gaps = F.split("text", ANY, -1)
    # a gap stands before each match, and one after the last
    whole = F.array_join(F.zip_with(gaps, F.zip_with("m", "p", lambda m, p: F.coalesce(p["value"], m)), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    done = F.filter("p", lambda p: p["value"].isNotNull())
    return made.select(
        "doc_id",
        F.when(F.size("m") > 0, whole).otherwise(F.col("text")).alias("text"),
        F.aggregate(done, F.lit(0), lambda s, p: s + p["n"]).cast("long").alias("n_pseudonyms"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(done, lambda p: p["kind"]))), ",").alias("kinds"),
    )
