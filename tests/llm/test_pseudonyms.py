import datetime
import re

import pytest
from pyspark.sql import functions as F

from hectara.llm import pseudonyms as ps
from hectara.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()]
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def iban_ok(value):
    packed = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def change(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in ps.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_formats_and_links(spark):
    values = ["+1 (988) 555-2485", "(988) 555-2485", "+49 30 1234567", "bo.s-t42@mail8.example.com", "4041894974608795", "4041-8949-7460-8795", "70.123.182.155",
              "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "123-45-6789", "1984-02-29", "29.02.1984", "02/29/1984", "31/12/1999"]
    got = change(spark, values)
    again = change(spark, ["x " + v + ", y" for v in values])
    assert again == ["x " + v + ", y" for v in got] and change(spark, values, "other") != got
    for old, new in zip(values, got):
        assert new != old
        if old.count(".") != 3 or "@" in old:
            assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", new)) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", old))
    assert got[0] == "+1 " + got[1] and re.match(r"\([2-9]\d\d\) [2-9]", got[1]) and got[2].startswith("+49 ")
    assert got[3].endswith("@mail8.example.com") and "bo.s-t42" not in got[3]
    assert luhn(got[4]) and got[5].replace("-", "") == got[4] and got[4][0] == "4"
    assert all(0 <= int(p) < 256 for p in got[6].split("."))
    assert iban_ok(got[7]) and got[8].replace(" ", "") == got[7] and got[7].startswith("DE")
    day = datetime.date.fromisoformat(got[10])
    assert got[11] == day.strftime("%d.%m.%Y") and got[12] == day.strftime("%m/%d/%Y") and 1900 <= day.year < 2100


def test_what_fails_its_check_stays(spark):
    texts = [None, "", "no values 4.0. 3.14", "4041894974608796", "999.1.1.1", "1.2.3.4.5", "1984-02-31", "2200-01-01", "000-12-3456", "DE89370400440532013001", "a@b", "call 555"]
    assert change(spark, texts) == texts


def test_permutation(spark):
    """Different values stay different, over whole small domains."""
    days = spark.range(ps.DAYS).select(F.expr(f"date_add(date'{ps.FIRST_DAY}', cast(id as int))").alias("d"))
    moved = days.select(ps.other_day(F.col("d"), "k").alias("m"))
    assert moved.distinct().count() == ps.DAYS
    assert moved.agg(F.min("m"), F.max("m")).first() == (datetime.date(1900, 1, 1), datetime.date(2099, 12, 31))
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert numbers.select(ps.permuted(F.col("v"), ps.plain_mask(F.col("v")), "k")).distinct().count() == 1000
    numbers = spark.range(0, 1_000_000_000, 333_337).select(F.regexp_replace(F.lpad(F.col("id").cast("string"), 9, "0"), r"^(...)(..)", "$1-$2-").alias("v")).filter(ps.ssn_valid(F.col("v")))
    moved = numbers.select(ps.ssn(F.col("v"), "k").alias("m"))
    assert moved.distinct().count() == numbers.count() and moved.filter(~ps.ssn_valid(F.col("m"))).count() == 0
    mails = spark.range(676).select(F.expr("concat(char(97 + id div 26), '.', char(97 + id % 26), '@x.org')").alias("v"))
    assert mails.select(ps.mail(F.col("v"), "k")).distinct().count() == 676


def test_columns_rows_and_long_texts(spark):
    text = "word " * 50_000 + "mail a.b@x.example.org " + "word " * 50_000
    df = spark.createDataFrame([(1, text, 5, "q"), (1, text, 5, "q"), (None, None, None, None)], "doc_id long, text string, n_pseudonyms int, _found string")
    out = ps.pseudonymise(df, "k")
    assert out.columns == ["doc_id", "text", "_found", "n_pseudonyms"]
    rows = out.collect()
    assert [r.n_pseudonyms for r in rows] == [1, 1, 0] and rows[0] == rows[1] and len(rows[0].text) == len(text) and "a.b@" not in rows[0].text
    assert ps.pseudonymise(df.limit(0), "k").count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op6_pseudonyms"](spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    rows = out.collect()
    assert len(rows) == len(texts) and any(r.n_pseudonyms for r in rows)
    values = r"[\w.]+@[\w.]+\.com|\(\d{3}\) 555-\d{4}|(?<!\d)\d{16}(?!\d)"
    for r in rows:
        old = {v for v in re.findall(values, texts[r.doc_id]) if not v.isdigit() or luhn(v)}
        assert not any(v in r.text for v in old) and (r.n_pseudonyms or r.text == texts[r.doc_id])


@pytest.mark.parametrize("value", ["4041 8949 7460 8795", "DE89 3704 0044 0532 0130 00"])
def test_layout(spark, value):
    packed = value.replace(" ", "")
    assert spark.range(1).select(ps.laid_out(F.lit(packed), F.lit(value))).first()[0] == value


PHONE, ADDRESS, CARD, IBAN, DAY = "+1 (826) 555-4081", "190.137.223.204", "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "2024-05-01"


def test_neighbouring_values(spark):
    """A value beside other digits or values gets the pseudonym that it has alone."""
    short, austrian = "4222222222222", "AT61 1904 3002 3457 3201"
    values = [PHONE, ADDRESS, CARD, IBAN, DAY, short, austrian, "+49 30 1234567", "a.b1@x.example.org"]
    alone = dict(zip(values, change(spark, values)))
    assert all(v != new for v, new in alone.items())
    rows = [
        [PHONE, " ", ADDRESS], [PHONE, " ", DAY], [PHONE, " ", CARD], ["+49 30 1234567", " ", ADDRESS], ["+49 30 1234567", " ", CARD], [CARD, " 12/27"], [CARD, " 123"],
        ["12 ", CARD], [short, " ", DAY], [CARD, " ", CARD, " ", DAY], [IBAN, " 12"], [austrian, " IBAN"], [austrian, " ", CARD], [ADDRESS, " ", PHONE], [DAY, " ", ADDRESS, " 7"],
        ["12 ", CARD, " 77 ", "a.b1@x.example.org"], ["no. 5 ", DAY, ", ", CARD, " 123; ", ADDRESS, "."],
    ]
    out = ps.pseudonymise(spark.createDataFrame([(i, "".join(r)) for i, r in enumerate(rows)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    for r, got in zip(rows, out):
        assert got.text == "".join(alone.get(x, x) for x in r) and got.n_pseudonyms == sum(x in alone for x in r)


def test_long_runs_of_numbers(spark):
    text = "7 " * 300 + CARD + " 12/27" + " 7" * 300
    got = change(spark, [text])[0]
    assert CARD not in got and len(got) == len(text)


def test_values_behind_other_characters(spark):
    card, day, ssn, address, phone = "4111111111111111", "2024-05-01", "123-45-6789", "10.20.30.40", "+49 30 1234567"
    alone = dict(zip((card, day, ssn, address, phone), change(spark, [card, day, ssn, address, phone])))
    heads = {"user_": card, "a.": card, "-": card, "SSN-": ssn, "log_": day, "x.": address, "tel-": phone, "no._": day}
    assert change(spark, [h + v for h, v in heads.items()]) == [h + alone[v] for h, v in heads.items()]
    kept = ["1.2.3.4.5", "3.4111111111111111", "2125550187", "12125550187", "9-123-45-6789"]
    assert change(spark, kept) == kept


def test_mail_of_other_letters_and_single_ones(spark):
    got = change(spark, ["jürgen.müller@bahn.de", "x ŁUKASZ.żak@poczta.pl y", "анна@почта.example.org", "анна@mail.example.org", "邮a.b@x.example.org"])
    for old, new in zip(["jürgen.müller", "x ŁUKASZ.żak"], got):
        local = new.split("@")[0]
        assert not any(a == b for a, b in zip(old.split(), local.split()) if len(a) > 2) and [c.isupper() for c in old] == [c.isupper() for c in local] and "üller" not in local and "ukasz" not in local.lower()
    assert got[0].endswith("@bahn.de") and got[3].endswith("@mail.example.org") and "анна" not in got[3] and got[2] == "анна@почта.example.org" and got[4].startswith("邮") and "a.b@" not in got[4]
    letters = "abcdefghijklmnopqrstuvwxyz"
    for key in ("k", "corpus-release-1"):
        rows = spark.createDataFrame([(i, f"{c}@{d}") for d in ("b.co", "c.co") for i, c in enumerate(letters)], "doc_id long, text string")
        out = [(r.text, r.n_pseudonyms) for r in ps.pseudonymise(rows, key).collect()]
        maps = ["".join(t[0] for t, _ in out if t.endswith(d)) for d in ("b.co", "c.co")]
        steps = {(ord(b) - ord(a)) % 26 for a, b in zip(letters, maps[0])}
        assert all(sorted(m) == list(letters) for m in maps) and maps[0] != maps[1] and len(steps) > 5 and {n for _, n in out} == {1}


def test_cards_by_a_plain_network(spark):
    """The pseudonyms of cards by a Feistel network written plainly."""
    import hashlib

    def plain(number, key):
        body, n = number[1:-1], (len(number) - 2) // 2
        left, right = body[:n], body[n:]
        for turn in range(1, ps.ROUNDS + 1):
            noise = hashlib.sha256(f"{key}|card|{turn}|{right}".encode()).hexdigest()
            left, right = right, "".join(str((int(c) + int(noise[2 * i:2 * i + 2], 16)) % 10) for i, c in enumerate(left))
        return next(d for d in (number[0] + left + right + str(c) for c in range(10)) if luhn(d))

    numbers = [n for n in (f"{4_000_000_000_000_000 + i * 7_919_191_919}" for i in range(300)) if luhn(n)]
    assert len(numbers) > 20 and change(spark, numbers, "key") == [plain(n, "key") for n in numbers]


def test_many_numbers_in_one_text(spark):
    """Three thousand numbers of 13 digits in one text, each found and looked at."""
    numbers = [str(1_000_000_000_000 + i * 7_919_191_919 % 8_999_999_999_999) for i in range(3_000)]
    got = change(spark, [" ".join(numbers)])[0].split(" ")
    assert len(got) == len(numbers) and all((a != b) == luhn(a) for a, b in zip(numbers, got))
