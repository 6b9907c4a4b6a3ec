"""PII: format-preserving Feistel pseudonyms, from SQL functions alone.

Card numbers (Luhn), IBANs (length of the country, mod 97), US social security numbers, telephone numbers, IPv4
addresses and dates that prove valid are permuted within their format under a key: digits keep their places and
separators, check digits are made anew, dates stay dates of their century. What is permuted is the value, not its
spelling: a number gets the same digits with and without spaces, a telephone number with ``+``, ``00`` or (in North
America) without a country code, a date in every order of its parts. Equal values get equal pseudonyms in all
documents; different ones of a kind stay different. E-mail names become a keyed digest. What doesn't prove valid
stays as it is.

The patterns have no loop around a group but of bounded or possessive ones, so no text makes the matcher recurse.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ["email", "iban", "ip", "date", "ssn", "card", "phone"]
# Lengths of IBANs by country (ISO 13616), and calling codes of two digits (E.164); 1 and 7 have one
# digit, all others three.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC", 33: "RU",
}
CALLING_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_IBAN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + ")"
#: What may be personal, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[./-][0-9])"
    rf"|(?<![0-9./-])[0-9]{{1,2}} {_MONTH} [0-9]{{4}}(?![0-9])|(?<![A-Za-z]){_MONTH} [0-9]{{1,2}}, [0-9]{{4}}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,4}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00 ?)(?:1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[1-9][0-9]{0,2}(?:[ ./-]?\([0-9]{1,5}\))?(?:[ ./-]?[0-9]{1,5}){2,6})(?![0-9])"
    r"|(?<![0-9A-Za-z+.-])(?:1[ .-])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9.-][0-9]|[0-9])"
    r"|(?<![0-9A-Za-z+.-])\(?0[1-9][0-9]{1,4}\)?[ /-][0-9]{3,8}(?:[ -][0-9]{2,6})?(?![0-9])",
}
ANY = "(?:" + "|".join(PATTERNS.values()) + ")"  #: the only groups that capture are the date's, so they keep their numbers


def _let(x: Column, f) -> Column:
    """f(x), x being worked out once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _mix(key: Column, tweak: Column, r: Column, x: Column) -> Column:
    """A keyed number below 2^52 from a round and half a value."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, tweak, r, x), 256), 1, 13), 16, 10).cast("long")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def feistel(a: Column, b: Column, mod_a, mod_b, key, tweak) -> Column:
    """A keyed permutation of pairs (a < mod_a, b < mod_b): in turns, one half gets a function of the other added."""
    start = F.struct(a.try_cast("long").alias("a"), b.try_cast("long").alias("b"))

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + _mix(_col(key), _col(tweak), r, s["b"]), _col(mod_a))).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + _mix(_col(key), _col(tweak), r, s["a"]), _col(mod_b))).alias("b"),
        )

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step)


def permuted_digits(d: Column, key, tweak) -> Column:
    """A string of 2 to 30 digits to another of that length; lengths are permuted apart."""
    n = F.length(d)
    half = F.floor(n / 2).cast("int")
    left, right = F.substring(d, F.lit(1), half), F.substring(d, half + 1, n)
    ten = lambda k: F.pow(F.lit(10), k).cast("long")
    joined = lambda out: F.concat(F.lpad(out["a"].cast("string"), half, "0"), F.lpad(out["b"].cast("string"), n - half, "0"))
    return _let(feistel(left, right, ten(half), ten(n - half), key, tweak), joined)


def luhn_sum(d: Column, doubled_last: bool) -> Column:
    """The Luhn sum of a digit string; the last digit is doubled, or the one before it."""
    digits = F.reverse(F.split(d, ""))
    values = F.transform(digits, lambda c, i: F.when((i % 2 == (0 if doubled_last else 1)) & (c.try_cast("int") > 4), c.try_cast("int") * 2 - 9).when(i % 2 == (0 if doubled_last else 1), c.try_cast("int") * 2).otherwise(c.try_cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))


def in_places(m: Column, digits: Column) -> Column:
    """m with its digits replaced, in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    digit = lambda c: c.rlike("^[0-9]$")
    step = lambda s, c: F.struct(F.concat(s["s"], F.when(digit(c), F.substring(digits, s["i"], F.lit(1))).otherwise(c)).alias("s"), (s["i"] + digit(c).cast("int")).alias("i"))
    return F.aggregate(F.split(m, ""), start, step)["s"]


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: Column) -> Column:
    d = _only_digits(m)
    checked = lambda body: F.concat(body, F.pmod(10 - luhn_sum(body, True) % 10, F.lit(10)).cast("string"))
    new = _let(permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"), checked)
    return F.when(F.length(d).between(13, 19) & (luhn_sum(d, False) % 10 == 0), _let(new, lambda x: in_places(m, x)))


def _mod97(s: Column) -> Column:
    """Of digits and capitals, A to Z standing for 10 to 35."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c)) % 97)


def _iban(m: Column, key: Column) -> Column:
    """The country and the letters of the account stay; its digits are permuted."""
    solid = F.regexp_replace(m, " ", "")
    land, body = F.substring(solid, 1, 2), F.substring(solid, F.lit(5), F.length(solid))
    valid = _mod97(F.concat(body, land, F.substring(solid, 3, 2))) == 1
    tweak = F.concat(F.lit("iban"), land, F.regexp_replace(body, "[0-9]", "0"))
    check = lambda digits: F.lpad((98 - _mod97(F.concat(in_places(body, digits), land, F.lit("00")))).cast("string"), 2, "0")
    new = _let(permuted_digits(_only_digits(body), key, tweak), lambda digits: F.concat(check(digits), digits))
    return F.when(valid, F.concat(land, _let(new, lambda x: in_places(F.substring(m, F.lit(3), F.length(m)), x))))


def _phone(m: Column, key: Column, home: str | None = None) -> Column:
    """The calling code stays; the national number, without a ``(0)`` after the code, is permuted among those of its
    code and length (in North America: among those that can be dialled)."""
    abroad = m.rlike(r"^(\+|00)")
    north = ~abroad & ~m.rlike(r"^\(?0")

    def coded(digits: Column) -> Column:
        """How many digits the code has in m, those of 00 counted too, and the code."""
        size = F.when(digits.rlike("^[17]"), 1).when(F.substring(digits, 1, 2).isin(*CALLING_2.split()), 2).otherwise(3)
        own = F.struct((size + F.when(m.startswith("00"), 2).otherwise(0)).alias("skip"), F.substring(digits, F.lit(1), size).alias("code"))
        here = F.struct(F.when(~north | (F.length(digits) == 11), 1).otherwise(0).alias("skip"), F.when(north, "1").otherwise(home or "0").alias("code"))
        return F.when(abroad, own).otherwise(here)

    def parted(c: Column) -> Column:
        # the national number begins after these digits, and after a bracketed 0
        head = F.coalesce(*(F.when(c["skip"] == k, F.regexp_extract(m, rf"^(?:[^0-9]*[0-9]){{{k}}}(?:[ ./-]?\(0\))?", 0)) for k in range(6)))
        return _let(head, lambda h: F.struct(c["code"].alias("code"), h.alias("head"), F.substring(m, F.length(h) + 1, F.length(m)).alias("rest"), _only_digits(F.substring(m, F.length(h) + 1, F.length(m))).alias("d")))

    def made(x: Column) -> Column:
        d = x["d"]
        dial = (x["code"] == "1") & d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
        at = feistel(F.substring(d, 1, 3).try_cast("long") - 200, F.substring(d, 4, 7).try_cast("long") - 2_000_000, 800, 8_000_000, key, "phone1")
        digits = _let(at, lambda a: F.concat((a["a"] + 200).cast("string"), (a["b"] + 2_000_000).cast("string")))
        new = F.when(dial, digits).otherwise(permuted_digits(d, key, F.concat(F.lit("phone"), x["code"])))
        valid = (F.length(d) >= 6) & (F.length(x["code"]) + F.length(d)).between(8, 15) & (~north | dial)
        return F.when(valid, F.concat(x["head"], _let(new, lambda n: in_places(x["rest"], n))))

    return _let(_let(_let(_only_digits(F.regexp_replace(m, r"^00 ?", "+")), coded), parted), made)


def _ssn(m: Column, key: Column) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    made = lambda out: F.concat_ws("-", pad(out["a"] + 1 + (out["a"] >= 665).cast("int"), 3), pad(F.floor(out["b"] / 9999) + 1, 2), pad(out["b"] % 9999 + 1, 4))
    return F.when(valid, _let(feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn"), made))


def _ip(m: Column, key: Column) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.try_cast("int"))
    o = [F.get(part, F.lit(i)) for i in range(4)]
    octets = lambda out: [F.floor(out["a"] / 256), out["a"] % 256, F.floor(out["b"] / 256), out["b"] % 256]
    new = _let(feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip"), lambda out: F.concat_ws(".", *(x.cast("string") for x in octets(out))))
    return F.when(F.forall(part, lambda x: x <= 255), new)


def _leap(y: Column) -> Column:
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


_LENGTH = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
_LATE = [sum(n - 12 for n in _LENGTH[:m]) for m in range(12)]  #: days after the 12th in the months before


def moved_day(y: Column, m: Column, d: Column, key) -> Column:
    """A valid day to another (y, m, d) of its century, by a permutation that keeps apart three classes: days to the
    12th, later ones, and February 29. So the order of a day and a month can be read as before."""
    century, year = F.floor(y / 100).cast("int"), y % 100
    tweak = F.concat(F.lit("date"), century.cast("string"))
    early = feistel(year, (m - 1) * 12 + d - 1, 100, 144, key, F.concat(tweak, F.lit("e")))
    starts = F.array(*map(F.lit, _LATE))
    late = feistel(year, F.get(starts, m - 1) + d - 13, 100, sum(n - 12 for n in _LENGTH), key, F.concat(tweak, F.lit("l")))
    late_m = lambda b: F.size(F.filter(starts, lambda s: s <= b))
    # the leap years of a century: 24 of them, the first year the 4th, or 25, the first year itself
    first = F.when(_leap(century * 100), 0).otherwise(1)
    n = F.floor(year / 4) - first
    rows, cols = F.when(first == 1, 4).otherwise(5), F.when(first == 1, 6).otherwise(5)
    leap = feistel(F.floor(n / cols), n % cols, rows, cols, key, F.concat(tweak, F.lit("f")))
    day = lambda y, m, d: F.struct((century * 100 + y).cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
    return (
        F.when(d <= 12, _let(early, lambda x: day(x["a"], F.floor(x["b"] / 12) + 1, x["b"] % 12 + 1)))
        .when((m == 2) & (d == 29), _let(leap, lambda x: day((x["a"] * cols + x["b"] + first) * 4, F.lit(2), F.lit(29))))
        .otherwise(_let(late, lambda x: day(x["a"], late_m(x["b"]), x["b"] - F.get(starts, late_m(x["b"]) - 1) + 13)))
    )


def _is_day(y: Column, m: Column, d: Column) -> Column:
    length = F.get(F.array(*map(F.lit, _LENGTH)), m - 1) + ((m == 2) & _leap(y)).cast("int")
    return F.coalesce(m.between(1, 12) & (d >= 1) & (d <= length), F.lit(False))


def _date(m: Column, key: Column) -> Column:
    """Year first; or year last, with / the month first if that is a date, else (and with . and -) the day, or else the
    month; or an English month, in full or three letters."""
    name, sep = F.regexp_extract(m, "[A-Z][a-z]+", 0), F.regexp_extract(m, "[-/.]", 0)
    number = lambda p, i: F.get(p, F.lit(i)).try_cast("int")
    named = F.array_position(F.array(*(F.lit(x[:3]) for x in MONTHS)), F.substring(name, 1, 3)).cast("int")
    pad = lambda x, wide: F.when(wide, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))

    def read(p: Column) -> Column:
        """The day, and how it is written: words, year first, month first or day first; both parts of two digits."""
        a, b, c = (number(p, i) for i in range(3))
        two = lambda i: F.length(F.get(p, F.lit(i))) == 2
        form = F.when(name != "", "w").when(F.length(p[0]) == 4, "y").when(F.when(sep == "/", _is_day(c, a, b)).otherwise(~_is_day(c, b, a)), "m").otherwise("d")
        day = lambda y, m, d, wide: F.struct(form.alias("form"), y.alias("y"), m.alias("m"), d.alias("d"), wide.alias("wide"))
        return _let(form, lambda f: F.when(f == "w", day(b, named, a, two(0))).when(f == "y", day(a, b, c, two(1) & two(2))).when(f == "m", day(c, a, b, two(0) & two(1))).otherwise(day(c, b, a, two(0) & two(1))))

    def written(new: Column, old: Column) -> Column:
        year, month, day = F.lpad(new["y"].cast("string"), 4, "0"), pad(new["m"], old["wide"]), pad(new["d"], old["wide"])
        whole = F.get(F.array(*map(F.lit, MONTHS)), new["m"] - 1)
        spelt = F.when(F.length(name) > 3, whole).otherwise(F.substring(whole, 1, 3))  # May counts as short
        spoken = F.when(m.rlike("^[0-9]"), F.concat_ws(" ", day, spelt, year)).otherwise(F.concat(spelt, F.lit(" "), day, F.lit(", "), year))
        f = old["form"]
        return F.when(f == "w", spoken).when(f == "y", F.concat(year, sep, month, sep, day)).when(f == "m", F.concat(month, sep, day, sep, year)).otherwise(F.concat(day, sep, month, sep, year))

    made = lambda o: F.when(_is_day(o["y"], o["m"], o["d"]), _let(moved_day(o["y"], o["m"], o["d"], key), lambda n: written(n, o)))
    return _let(_let(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), read), made)


def _email(m: Column, key: Column) -> Column:
    """An address whose host has two parts or more, the last of letters; the name becomes a digest of the address."""
    name = F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(m)), 256), 1, 16)
    host = F.substring_index(m, "@", -1)
    return F.when(host.rlike(r"\.[A-Za-z]{2,}$") & ~host.contains(".."), F.concat(F.lit("u"), name, F.lit("@"), host))


MAKE = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(m: Column) -> Column:
    return reduce(lambda c, k: c.when(m.rlike(f"^(?:{PATTERNS[k]})$"), k), KINDS[1:], F.when(m.rlike(f"^(?:{PATTERNS[KINDS[0]]})$"), KINDS[0]))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def pseudonymise(docs: DataFrame, key: str | DataFrame, id_col: str = "doc_id", text_col: str = "text", home: str | None = None) -> DataFrame:
    """One row a document: doc_id, text (with pseudonyms), and how many values of each kind were replaced.

    ``key`` is a secret or a table of one row and column that holds it; it is read by a scalar subquery, so plans and
    event logs don't show it. ``home`` is the calling code that telephone numbers with a leading 0 are of; without it
    they are linked among themselves only.

    Null texts stay null with counts 0; texts without digits or @ are passed on as they are. Rows are independent:
    repeated rows, ties, null ids and extra columns change nothing, and an empty table gives an empty one.
    """
    keys = docs.sparkSession.sql("SELECT * FROM VALUES (:secret) AS t (k)", {"secret": key}) if isinstance(key, str) else key
    text = F.col("t")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    rows = rows.withColumn("secret", keys.scalar())

    def one(m: Column) -> Column:
        make = lambda k: _phone(m, F.col("secret"), home) if k == "phone" else MAKE[k](m, F.col("secret"))
        new = lambda kind: F.coalesce(*(F.when(kind == k, make(k)) for k in KINDS))
        out = lambda kind, x: F.struct(F.when(x.isNotNull(), kind).alias("kind"), F.coalesce(x, m).alias("new"))
        return _let(kind_of(m), lambda kind: _let(new(kind), lambda x: out(kind, x)))

    rows = rows.withColumn("new", F.transform("found", one))
    pieces = F.zip_with(F.split(text, ANY, -1), F.concat(F.col("new.new"), F.array(F.lit(""))), lambda p, r: F.concat(p, r))
    out = F.when(F.size("found") == 0, text).otherwise(F.array_join(pieces, ""))
    counts = [F.size(F.filter("new", _is(k))).alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", out.alias("text"), *counts)
