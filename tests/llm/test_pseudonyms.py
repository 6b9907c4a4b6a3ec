"""Pseudonyms against a plain Python version: every kind and spelling, long texts, odd rows, and no recursion."""

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from catalune.llm import pseudonyms as P

KEY = "k1"


def pair(a, b, mod_a, mod_b, tweak):
    for r in range(P.ROUNDS):
        x = b if r % 2 == 0 else a
        v = int(hashlib.sha256(f"{KEY}|{tweak}|{r}|{x}".encode()).hexdigest()[:13], 16)
        a, b = ((a + v) % mod_a, b) if r % 2 == 0 else (a, (b + v) % mod_b)
    return a, b


def digits(d, tweak):
    h = len(d) // 2
    a, b = pair(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), tweak)
    return f"{a:0{h}d}{b:0{len(d) - h}d}"


def luhn(d):
    return sum((c * 2 - 9 * (c > 4)) if i % 2 else c for i, c in enumerate(map(int, reversed(d)))) % 10 == 0


def card(d):
    body = digits(d[:-1], "card")
    return next(body + c for c in "0123456789" if luhn(body + c))


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(s):
    shape = re.sub("[0-9]", "0", s[4:])
    new = iter(digits(re.sub("[^0-9]", "", s[4:]), "iban" + s[:2] + shape))
    body = re.sub("[0-9]", lambda _: next(new), s[4:])
    return s[:2] + f"{98 - mod97(body + s[:2] + '00'):02d}" + body


def phone(code, national):
    if code == "1" and re.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", national):
        a, b = pair(int(national[:3]) - 200, int(national[3:]) - 2_000_000, 800, 8_000_000, "phone1")
        return f"{a + 200}{b + 2_000_000}"
    return digits(national, "phone" + code)


def day(x):
    c, y = divmod(x.year, 100)
    if x.day <= 12:
        y, k = pair(y, (x.month - 1) * 12 + x.day - 1, 100, 144, f"date{c}e")
        return datetime.date(c * 100 + y, k // 12 + 1, k % 12 + 1)
    if (x.month, x.day) == (2, 29):
        leaps = [y for y in range(c * 100, c * 100 + 100) if y % 4 == 0 and (y % 100 or y % 400 == 0)]
        rows, cols = (4, 6) if len(leaps) == 24 else (5, 5)
        i = leaps.index(x.year)
        a, b = pair(i // cols, i % cols, rows, cols, f"date{c}f")
        return datetime.date(leaps[a * cols + b], 2, 29)
    late = [(m, d) for m in range(1, 13) for d in range(13, P._LENGTH[m - 1] + 1)]
    y, k = pair(y, late.index((x.month, x.day)), 100, len(late), f"date{c}l")
    return datetime.date(c * 100 + y, *late[k])


def filled(shape, new):
    it = iter(new)
    return re.sub("[0-9]", lambda _: next(it), shape)


def run(spark, texts, **how):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r["doc_id"]: r for r in P.pseudonymise(d, KEY, **how).collect()}


def test_every_kind_and_spelling(spark):
    rnd, want = random.Random(3), []
    for _ in range(20):
        d = "".join(rnd.choices("0123456789", k=15))
        d += next(c for c in "0123456789" if luhn(d + c))
        for shape in (d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}"):
            want.append(("card", shape, filled(shape, card(d))))
        a = "37" + "".join(rnd.choices("0123456789", k=12))
        a += next(c for c in "0123456789" if luhn(a + c))
        want.append(("card", f"{a[:4]} {a[4:10]} {a[10:]}", filled(f"{a[:4]} {a[4:10]} {a[10:]}", card(a))))
        for land, n in (("DE", 18), ("NO", 11)):
            body = "".join(rnd.choices("0123456789", k=n))
            s = land + f"{98 - mod97(body + land + '00'):02d}" + body
            new = iban(s)
            want += [("iban", s, new), ("iban", " ".join(s[i : i + 4] for i in range(0, len(s), 4)), " ".join(new[i : i + 4] for i in range(0, len(s), 4)))]
        nat = f"{rnd.randint(200, 999)}{rnd.randint(200, 999)}{rnd.randint(0, 9999):04d}"
        new = phone("1", nat)
        for form in ("+1 ({}) {}-{}", "+1{}{}{}", "001 {} {} {}", "1-{}-{}-{}", "({}) {}-{}", "{}-{}-{}", "{}.{}.{}"):
            want.append(("phone", form.format(nat[:3], nat[3:6], nat[6:]), form.format(new[:3], new[3:6], new[6:])))
        nat = str(rnd.randint(10**8, 10**9 - 1))
        new = phone("49", nat)
        for form in ("+49 {} {}", "+49{}{}", "0049 {} {}", "+49 (0){} {}", "+49 (0) {} {}"):
            want.append(("phone", form.format(nat[:2], nat[2:]), form.format(new[:2], new[2:])))
        x = datetime.date(rnd.randint(1700, 2199), 1, 1) + datetime.timedelta(rnd.randrange(365))
        y = day(x)
        for form in ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d-%m-%Y", "%m/%d/%Y", "%d %B %Y", "%d %b %Y", "%b %d, %Y"):
            if x.month != 5 and y.month != 5 or "%b" not in form and "%B" not in form:
                want.append(("date", x.strftime(form), y.strftime(form)))
        if x.day > 12:
            want += [("date", x.strftime("%d/%m/%Y"), y.strftime("%d/%m/%Y")), ("date", x.strftime("%m.%d.%Y"), y.strftime("%m.%d.%Y"))]
        o = [rnd.randrange(256) for _ in range(4)]
        a, b = pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        want.append(("ip", ".".join(map(str, o)), f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"))
        area, group, serial = rnd.choice([rnd.randint(1, 665), rnd.randint(667, 899)]), rnd.randint(1, 99), rnd.randint(1, 9999)
        a, b = pair(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
        want.append(("ssn", f"{area:03d}-{group:02d}-{serial:04d}", f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"))
        mail = f"Name.{rnd.randrange(99)}@mail.Example.com"
        want.append(("email", mail, "u" + hashlib.sha256(f"{KEY}|email|{mail.lower()}".encode()).hexdigest()[:16] + "@mail.Example.com"))
    got = run(spark, [f"before {w[1]}, after" for w in want] + ["; ".join(w[1] for w in want)])
    for i, (kind, old, new) in enumerate(want):
        assert got[i]["text"] == f"before {new}, after", (kind, old)
        assert got[i][f"n_{kind}"] == 1 and sum(got[i][f"n_{k}"] for k in P.KINDS) == 1
    assert got[len(want)]["text"] == "; ".join(w[2] for w in want)


def test_what_is_not_valid_stays(spark):
    texts = ["1234567890123456 4539148803436468", "666-12-3456 900-12-3456 123-00-4567 123-45-0000", "1984-02-30 31.11.1999 13/13/2000 29.02.1900 00.01.2000", "300.1.1.1 1.2.3.4.5", "DE89370400440532013001 GB82 WEST 1234 5698 7654 33", "me@host a@b..com x@y.1", "123-456-7890 555-3824 +0 123", "v4.0 3. text 12:30 2001-2002"]
    got = run(spark, texts)
    assert [got[i]["text"] for i in range(len(texts))] == texts


def test_home_links_numbers_with_a_leading_zero(spark):
    got = run(spark, ["030 1234567", "+49 30 1234567"], home="49")
    new = phone("49", "301234567")
    assert got[0]["text"] == f"0{new[:2]} {new[2:]}" and got[1]["text"] == f"+49 {new[:2]} {new[2:]}"
    alone = run(spark, ["030 1234567"])
    assert alone[0]["text"] != "030 1234567"


def test_days_are_permuted_in_their_classes(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1900-01-01', DATE'1999-12-31')) AS x")
    new = days.select("x", P.moved_day(F.year("x"), F.month("x"), F.dayofmonth("x"), "k").alias("n")).select("x", F.make_date("n.y", "n.m", "n.d").alias("z")).collect()
    assert len({r["z"] for r in new}) == len(new) == 36524 and all((r["x"].day <= 12) == (r["z"].day <= 12) and r["z"].year // 100 == 19 for r in new)


@pytest.mark.parametrize("text", ["a@b." + "b." * 2000 + "com", "a@" + "b." * 300_000, "a." * 300_000 + "@b.c", "1" * 600_000, "1-" * 300_000, "+1 " * 200_000, "x" * 1_000_000 + " 1", "00 " * 200_000, "12 " * 200_000, "AA11" * 200_000])
def test_long_texts_do_not_recurse(spark, text):
    got = run(spark, [text])[0]
    assert len(got["text"]) >= len(text) - 20


def test_many_values_in_a_long_text(spark):
    got = run(spark, ["1984-02-28 10.0.0.1 " * 20_000])[0]
    assert got["n_date"] == got["n_ip"] == 20_000 and len(set(got["text"].split())) == 2


def test_odd_rows(spark, odd):
    got = P.pseudonymise(odd.withColumns({c: F.lit("own") for c in ("t", "found", "secret", "new", "kind")}), KEY).collect()
    assert len(got) == 13 and sorted(str(r["text"]) for r in got) == sorted(str(r["text"]) for r in odd.collect())
    assert P.pseudonymise(odd.limit(0), KEY).count() == 0


def test_the_key_is_not_in_the_plan(spark, docs):
    q = P.pseudonymise(docs, "very-secret")._jdf.queryExecution()
    assert "very-secret" not in q.toString() and "Python" not in q.executedPlan().toString()
