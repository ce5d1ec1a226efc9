"""Format-preserving pseudonyms for personal data, in built-in functions only.

Numbers and dates that pass their check (Luhn, mod 97, octets, calendar, valid
ranges) go through a keyed Feistel permutation of their own domain, so the
pseudonym has the same format and passes the same check, two values never
share one, and equal values get equal pseudonyms in every document:

* card numbers of 13 to 19 digits: digits but the last are permuted, the Luhn
  digit is set anew;
* IBANs: the digits of the account part are permuted, the check digits set anew;
* telephone numbers, also of 8 to 15 digits after a plus without separators:
  the digits after the country code are permuted;
* social security numbers, IPv4 addresses, dates of 1800 to 2199: the index
  within all valid values is permuted. A date keeps its notation, and the same
  day in two notations gets the same day.

Mail addresses keep their domain and get a keyed local part; secrets
(``token = "..."`` and the like: 20 hexadecimal digits or more, or 16 characters
or more in quotes with a digit among them) get keyed characters of the same
kinds, whatever their length.
What fails its check (a 16-digit order number, say) stays as it is.

Cases: null text stays null; an empty text and one without findings are returned
unchanged; a text is read whole, whatever its length; of findings that begin at
one place the first kind of ``PATTERNS`` counts; repeated rows do not matter
(each row is on its own); other columns pass through, whatever their names. Output columns ``text``, ``n_private`` and ``kinds`` replace
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10  # even, so that both halves are back in place
_YEARS_FROM = "1800-01-01"
_DAYS = (189, 773)  # 189 * 773 = 146097 days, 400 Gregorian years

_B, _E = r"(?<!\d)(?<!\d[.])", r"(?!\d)(?![.]\d)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Countries of each IBAN length, so that a match ends where the IBAN does and what follows it stays out.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(
    rf"(?:{'|'.join(lands.split())})\d{{2}}(?:[A-Z0-9]{{{n - 4}}}|(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}{f' [A-Z0-9]{{{n % 4}}}' if n % 4 else ''})"
    for n, lands in _IBAN_LENGTHS.items()
)
#: Country codes of telephone numbers written without separators: of one and two digits, else three.
_LAND = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_NAMED = r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3})"
#: Fixed patterns, one for each kind; the order decides which wins at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+[.]){1,126}[A-Za-z]{2,63}(?![A-Za-z0-9-])",
    "secret": _NAMED + r"(?:[\"']?[0-9A-Fa-f]{20,}+(?![0-9A-Za-z])|[\"'](?=[^\"'\s]*[0-9])[A-Za-z0-9_./+=-]{16,}+(?=[\"']))",
    "iban": rf"\b(?:{_IBANS})\b|" + r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "ip": _B + rf"{_OCTET}(?:[.]{_OCTET}){{3}}" + _E,
    "phone": r"(?:(?<!\d)\+\d(?:(?! \d{4}[/-]\d{2}[/-]\d{2})[ .-]?\(?\d\)?){7,14}(?<=\d\d)(?!\d)|(?<!\d)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}|"
    + _B
    + r"\d{3}[.-]\d{3}[.-]\d{4})"
    + r"(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}[.]\d{1,2}[.]\d{4})(?![\d/-])",
    "card": r"(?<!\d)(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hash(key: str, *parts: Column | str) -> Column:
    """A keyed whole number below 2**60."""
    text = F.concat_ws("\x1f", F.lit(key), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit(key))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """Keyed permutation of all digit strings of one length (2 to 30): an alternating Feistel network over its halves."""

    def network(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")

        def turn(s: Column, i: Column) -> Column:
            width = F.length(s["a"])
            whole = F.pow(F.lit(10.0), width).cast("long")
            total = F.pmod(s["a"].cast("long") + F.pmod(_hash(key, tweak, n, i, s["b"]), whole), whole)
            return F.struct(s["b"].alias("a"), F.lpad(total.cast("string"), width, "0").alias("b"))

        start = F.struct(F.substring(d, F.lit(1), half).alias("a"), F.substring(d, half + 1, n).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))

    return _let(digits, network)


def permute_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, tweak: str) -> Column:
    """Keyed permutation of Z_a x Z_b: the halves are shifted in turn by a keyed function of the other."""

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, s["b"]).otherwise(s["a"])
        shift = _hash(key, tweak, i, other)
        return F.struct(
            F.when(even, F.pmod(s["a"] + F.pmod(shift, F.lit(size_a)), F.lit(size_a))).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(shift, F.lit(size_b)), F.lit(size_b))).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order."""

    def fill(d: Column) -> Column:
        def at(i: Column) -> Column:
            seen = F.length(_digits(F.substring(template, F.lit(1), i)))
            c = F.substring(template, i, F.lit(1))
            return F.when(c.between("0", "9"), F.substring(d, seen, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(template)), at), "")

    return _let(digits, fill)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number whose last digit is the check digit."""

    def total(s: Column) -> Column:
        def add(so_far: Column, i: Column) -> Column:
            d = F.substring(s, i, F.lit(1)).cast("int")
            twice = (F.length(s) - i) % 2 == 1
            return so_far + F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)

    return _let(digits, total)


def _card(m: Column, key: str) -> Column:
    own = _let(_digits(m), lambda d: F.substring(d, F.lit(1), F.length(d) - 1))

    def with_check(mixed: Column) -> Column:
        check = F.pmod(10 - F.pmod(luhn_sum(F.concat(mixed, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
        return F.concat(mixed, check)

    return _refill(m, _let(permute_digits(own, key, "card"), with_check))


def _mod97(s: Column) -> Column:
    """A letter counts as two digits, A as 10."""

    def total(t: Column) -> Column:
        def add(r: Column, i: Column) -> Column:
            c = F.substring(t, i, F.lit(1))
            v = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
            return F.pmod(r * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))

        return F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), add)

    return _let(s, total)


def _iban_valid(m: Column) -> Column:
    return _let(
        F.regexp_replace(m, " ", ""),
        lambda s: F.length(s).between(15, 34) & (_mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1),
    )


def _iban(m: Column, key: str) -> Column:
    s = F.regexp_replace(m, " ", "")
    land, account = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))

    def whole(mixed: Column) -> Column:
        return F.concat(land, F.lpad((98 - _mod97(F.concat(mixed, land, F.lit("00")))).cast("string"), 2, "0"), mixed)

    mixed = F.when(F.length(_digits(account)) >= 2, _refill(account, permute_digits(_digits(account), key, "iban"))).otherwise(account)
    return _let(_let(mixed, whole), lambda flat: F.when(m.contains(" "), F.trim(F.regexp_replace(flat, "(.{4})", "$1 "))).otherwise(flat))


def _phone(m: Column, key: str) -> Column:
    land = F.regexp_extract(m, r"^\+(?:\d{1,3}(?=[ .(-])|" + _LAND + ")", 0)
    rest = F.substring(m, F.length(land) + 1, F.length(m))
    return F.concat(land, _refill(rest, permute_digits(_digits(rest), key, "phone")))


def _ssn_valid(m: Column) -> Column:
    return m.rlike(r"^(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")


def _ssn(m: Column, key: str) -> Column:
    area = F.substring(m, 1, 3).cast("int")
    a = area - 1 - (area > 666).cast("int")
    b = (F.substring(m, 5, 2).cast("int") - 1) * 9999 + F.substring(m, 8, 4).cast("int") - 1
    return _let(
        permute_pair(a, b, 898, 99 * 9999, key, "ssn"),
        lambda v: F.format_string(
            "%03d-%02d-%04d", v["a"] + 1 + (v["a"] + 1 >= 666).cast("int"), F.floor(v["b"] / 9999) + 1, v["b"] % 9999 + 1
        ),
    )


def _ip(m: Column, key: str) -> Column:
    o = F.split(m, "[.]")
    v = permute_pair(
        o[0].cast("int") * 256 + o[1].cast("int"), o[2].cast("int") * 256 + o[3].cast("int"), 65536, 65536, key, "ip"
    )
    parts = lambda v: [x for h in ("a", "b") for x in (F.shiftright(v[h].cast("int"), 8), v[h].cast("int") % 256)]
    return _let(v, lambda v: F.concat_ws(".", *parts(v)))


#: Notation: pattern of the text and the date format; of two that fit, the first valid one counts.
_NOTATIONS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{2}[.]\d{2}[.]\d{4}$", "dd.MM.yyyy"),
    (r"^\d{1,2}[.]\d{1,2}[.]\d{4}$", "d.M.yyyy"),
)


def _day(m: Column, pattern: str, notation: str) -> Column:
    day = F.when(m.rlike(pattern), F.to_date(F.try_to_timestamp(m, F.lit(notation))))
    return F.when(day.between(F.lit("1800-01-01").cast("date"), F.lit("2199-12-31").cast("date")), day)


def _date_valid(m: Column) -> Column:
    return F.coalesce(*[_day(m, *x) for x in _NOTATIONS]).isNotNull()


def _date(m: Column, key: str) -> Column:
    first = F.lit(_YEARS_FROM).cast("date")
    n = F.datediff(F.coalesce(*[_day(m, *x) for x in _NOTATIONS]), first)
    mixed = _let(n, lambda n: permute_pair(F.floor(n / _DAYS[1]), n % _DAYS[1], *_DAYS, key, "date"))
    new = _let(mixed, lambda v: F.date_add(first, (v["a"] * _DAYS[1] + v["b"]).cast("int")))
    return _let(new, lambda day: F.coalesce(*[F.when(_day(m, p, f).isNotNull(), F.date_format(day, f)) for p, f in _NOTATIONS]))


def _email(m: Column, key: str) -> Column:
    name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    new = F.concat(F.lit("user"), F.lpad(F.pmod(_hash(key, "email", F.lower(m)), F.lit(10**12)).cast("string"), 12, "0"))
    return F.concat(F.when(name == F.upper(name), F.upper(new)).otherwise(new), F.lit("@"), domain)


def _secret(m: Column, key: str) -> Column:
    """Hexadecimal digits become others, else each letter or digit one of its own kind; marks stay."""
    value = F.regexp_extract(m, r"[=:]\s{0,3}[\"']?(\S+)$", 1)

    def new(v: Column) -> Column:
        hexadecimal = v.rlike("^[0-9A-Fa-f]+$")
        said = F.when(hexadecimal, F.lower(v)).otherwise(v)
        block = lambda i: F.sha2(F.concat_ws("\x1f", F.lit(key), i.cast("string"), said, F.lit(key)).cast("binary"), 256)
        stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(v) / 32).cast("int")), block), "")

        def fill(drawn: Column) -> Column:
            def at(i: Column) -> Column:
                c = F.substring(v, i, F.lit(1))
                x = F.conv(F.substring(drawn, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
                letter = F.when(hexadecimal, F.substring(F.lit("0123456789abcdef"), x % 16 + 1, F.lit(1)))
                letter = letter.when(c.rlike("[0-9]"), (x % 10).cast("string")).when(c.rlike("[A-Za-z]"), F.char(97 + x % 26)).otherwise(c)
                return F.when(c.rlike("[A-Z]") | (hexadecimal & (v == F.upper(v))), F.upper(letter)).otherwise(letter)

            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), at), "")

        return _let(stream, fill)

    return _let(value, lambda v: F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(v)), new(v)))


def _kind(m: Column) -> Column:
    """Kind of a match that passes its check, else null."""
    whole = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    n = F.length(_digits(m))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^" + _NAMED), "secret")
        .when(m.rlike("^[A-Z]{2}"), F.when(_iban_valid(m), "iban"))
        .when(whole("ip"), "ip")
        .when(whole("ssn"), F.when(_ssn_valid(m), "ssn"))
        .when(whole("date"), F.when(_date_valid(m), "date"))
        .when(whole("card"), F.when(luhn_sum(_digits(m)) % 10 == 0, "card"))
        .when(n.between(F.when(m.startswith("+"), 8).otherwise(9), 15), "phone")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """What stands for the match; the match itself where ``kind`` is null."""
    out = F.when(kind.isNull(), m)
    for name, make in (
        ("email", _email),
        ("secret", _secret),
        ("iban", _iban),
        ("ip", _ip),
        ("ssn", _ssn),
        ("date", _date),
        ("card", _card),
        ("phone", _phone),
    ):
        out = out.when(kind == name, make(m, key))
    return out.otherwise(m)


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with pseudonyms in its text, ``n_private`` (findings) and ``kinds`` (their kinds, in order).

    The key should come from a secret store; whoever has it can link and undo
    pseudonyms.
    """
    def fresh(name: str) -> str:
        return fresh(name + "_") if name in df.columns else name

    f, m, g = map(fresh, ("found", "marked", "gaps"))
    t, marks, gaps = F.col(f"`{text}`"), F.col(m), F.col(g)
    found = F.when(t.rlike("[0-9@=:]"), F.regexp_extract_all(t, F.lit(_ANY), F.lit(0)))
    marked = F.when(
        F.size(f) > 0,
        F.transform(
            F.transform(f, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind"))),
            lambda x: F.struct(pseudonym(x["m"], x["kind"], key).alias("new"), x["kind"].alias("kind")),
        ),
    )
    some = F.exists(marks, lambda x: x["kind"].isNotNull())
    new = F.concat(
        F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(marks)), marks, lambda gap, x: F.concat(gap, x["new"])), ""),
        F.element_at(gaps, -1),
    )
    kinds = F.filter(F.transform(marks, lambda x: x["kind"]), lambda k: k.isNotNull())
    return (
        df.withColumn(f, found)
        .withColumn(m, marked)
        .withColumn(g, F.when(some, F.split(t, _ANY, -1)))
        .select(
            *[F.col(f"`{c}`") if c != text else F.when(gaps.isNotNull(), new).otherwise(t).alias(text) for c in df.columns if c not in ("n_private", "kinds")],
            F.coalesce(F.size(F.when(some, kinds)), F.lit(0)).alias("n_private"),
            F.coalesce(F.when(some, kinds), F.array().cast("array<string>")).alias("kinds"),
        )
    )


def op6_pii(documents: DataFrame, key: str = "demonstration key") -> DataFrame:
    """Pseudonymised whole texts."""
    return pseudonymise(documents.select("doc_id", "text"), key)
