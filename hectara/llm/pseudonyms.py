"""Format-preserving pseudonyms for personal data.

Found values are checked first (Luhn digit, mod 97, number ranges, calendar) and then permuted by a keyed Feistel network
within their own format: the two halves of a value take turns, each character of one half is shifted within its alphabet
by a hash of the key, the round and the other half. A network is a permutation whatever the hash, so equal values
get equal pseudonyms in all documents, however a number is grouped, and different values stay different. Check digits are computed anew; dates are
permuted among the days of 1900 to 2099, addresses among all IPv4 addresses. A span that fails its check, say a card with further
digits beside it, is searched for shorter values and other kinds. DataFrame functions only, no shuffle.

Local parts of mail addresses may hold Latin, Greek and Cyrillic letters, each permuted within its script and case; other scripts and combining
marks end a local part. A local part of one character goes through a keyed permutation of its alphabet that differs by domain. A value may stand behind
letters and a _, . or - (user_4111...), but not behind a digit and a point, where it is a decimal fraction. Ten or eleven bare digits are no phone.

Defined results: null stays null, texts without values and values that fail their check stay as they are; a country code,
the first digit of a card, the domain of a mail address and all separators stay; columns of the input are kept, text is replaced
and n_pseudonyms is added or replaced. A value that its permutation leaves as it is counts as replaced.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hectara.llm.common import packed, unpacked

ROUNDS = 8
WALKS = 24
FIRST_DAY, DAYS, DAYS_LEFT, DAYS_RIGHT = "1900-01-01", 73049, 17, 4297  # 17 * 4297 days are exactly two centuries
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets by the letter that stands for them in a mask; all other mask characters keep what they cover.
ALPHABETS = {"9": DIGITS, "N": "23456789", "a": LOWER, "A": UPPER}

#: The letters of other scripts, by script and case.
SCRIPTS = {"l": (0xC0, 0x17F), "g": (0x386, 0x3CE), "c": (0x400, 0x45F)}
WIDE = {sign if lower else sign.upper(): "".join(c for c in map(chr, range(low, high + 1)) if (c.islower() if lower else c.isupper())) for sign, (low, high) in SCRIPTS.items() for lower in (True, False)}
LETTER = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F\u0386\u0388-\u03CE\u0400-\u045F"

MAIL = rf"[{LETTER}0-9][{LETTER}0-9._%+-]{{0,63}}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,24}}"
IPV4 = r"(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ISO_DAY = r"\d{4}-\d{2}-\d{2}(?![\d-])"
POINT_DAY = r"\d{2}\.\d{2}\.\d{4}(?!\.?\d)"
SLASH_DAY = r"\d{2}/\d{2}/\d{4}(?![\d/])"
SSN = r"\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"\d(?:[ -]?\d){12,18}(?![\d])"
AMERICAN = r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|\d{3}-\d{3}-\d{4}(?![\d-])"
#: What ends a phone number, so that it does not take the first digits of its neighbour.
NEIGHBOUR = rf"(?:{IPV4}|{ISO_DAY}|{POINT_DAY}|{SLASH_DAY}|{SSN}|\d{{4}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d|\d{{13,19}}(?!\d))"
PHONE = rf"{AMERICAN}|\+\d{{1,3}}(?:(?! {NEIGHBOUR})[ .-]?\(?\d{{2,4}}\)?){{2,5}}(?!\d)"
#: What may not stand before a value; numbers may follow letters with a _, . or - between.
BEFORE_MAIL, BEFORE_NUMBER = rf"(?<![{LETTER}0-9._%+@-])", r"(?<![A-Za-z0-9%+@])(?<!\d[.])"
FOUND = rf"{BEFORE_MAIL}(?:{MAIL})|{BEFORE_NUMBER}(?:{IPV4}|{IBAN}|(?<!\d-)(?:{ISO_DAY}|{POINT_DAY}|{SLASH_DAY}|{SSN})|{CARD}|(?<!\d-)(?:{PHONE}))"

#: A found value and what adjoins it: the rest of its word and the words after it that hold digits.
RUN = rf"(?:{FOUND})(?: ?[^\s]*\d[^\s]*)*+"
WINDOW, LONGEST, SHORTEST = 400, 48, 7  # characters looked at from the start of a value; lengths of values but mail addresses


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def shifted(half: Column, mask: Column, noise: Column, alphabets: dict[str, str]) -> Column:
    """Each character moved within the alphabet of its mask by two hexadecimal digits of the noise."""

    def move(i: Column) -> Column:
        c, m = F.substr(half, i, F.lit(1)), F.substr(mask, i, F.lit(1))
        step = F.conv(F.substr(noise, (i - 1) % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for sign, letters in alphabets.items():
            place = (F.instr(F.lit(letters), c) - 1 + step) % len(letters) + 1
            out = F.when(m == sign, F.substr(F.lit(letters), place, F.lit(1))).otherwise(out)
        return out

    places = F.when(F.length(half) > 0, F.sequence(F.lit(1), F.length(half))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, move), "")


def permuted(value: Column, mask: Column, key: str, alphabets: dict[str, str] = ALPHABETS) -> Column:
    """The value under the network; mask names the alphabet of each character."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(
        F.substr(value, F.lit(1), cut).alias("l"), F.substr(mask, F.lit(1), cut).alias("lm"),
        F.substr(value, cut + 1).alias("r"), F.substr(mask, cut + 1).alias("rm"),
    )

    def turn(s: Column, i: Column) -> Column:
        noise = F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), s["r"]), 256)
        return F.struct(s["r"].alias("l"), s["rm"].alias("lm"), shifted(s["l"], s["lm"], noise, alphabets).alias("r"), s["lm"].alias("rm"))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, turn, lambda s: F.concat(s["l"], s["r"]))


def plain_mask(value: Column) -> Column:
    return F.translate(value, DIGITS + LOWER + UPPER, "9" * 10 + "a" * 26 + "A" * 26)


def wide_mask(value: Column) -> Column:
    return F.translate(plain_mask(F.translate(value, "".join(WIDE.values()), "".join(chr(0xE000 + i) * len(v) for i, v in enumerate(WIDE.values())))), "".join(chr(0xE000 + i) for i in range(len(WIDE))), "".join(WIDE))


def lone(value: Column, tweak: Column, key: str) -> Column:
    """One character among its alphabet, whose letters are ordered by a hash of the key, the tweak and themselves."""
    out = value
    for letters in (DIGITS, LOWER, UPPER, *WIDE.values()):
        order = F.array_sort(F.transform(F.array(*[F.lit(c) for c in letters]), lambda c: F.struct(F.sha2(F.concat_ws("|", F.lit(key), tweak, c), 256).alias("h"), c.alias("c"))))
        place = F.instr(F.lit(letters), value)
        out = F.when(place > 0, F.get(order, place - 1)["c"]).otherwise(out)
    return out


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits whose last one is a check digit."""

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, F.lit(2)).otherwise(F.lit(1))
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(characters(F.reverse(digits)), weigh), F.lit(0), lambda a, d: a + d)


def mod97(text: Column) -> Column:
    """The number that letters (A is 10) and digits spell, modulo 97."""

    def step(a: Column, c: Column) -> Column:
        letter = F.instr(F.lit(UPPER), c)
        return F.when(letter > 0, (a * 100 + letter + 9) % 97).otherwise((a * 10 + c.cast("int")) % 97)

    return F.aggregate(characters(text), F.lit(0), step)


def laid_out(packed: Column, value: Column) -> Column:
    """The characters of packed in the places of value's letters and digits, between its separators."""

    def place(i: Column) -> Column:
        c = F.substr(value, i, F.lit(1))
        number = F.length(F.regexp_replace(F.substr(value, F.lit(1), i), r"[^A-Za-z0-9]", ""))
        return F.when(c.rlike("[A-Za-z0-9]"), F.substr(packed, number, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), place), "")


def card(value: Column, key: str) -> Column:
    digits = digits_of(value)
    body = F.substr(digits, F.lit(2), F.length(digits) - 2)
    moved = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permuted(body, plain_mask(body), key))
    check = (10 - luhn_sum(F.concat(moved, F.lit("0"))) % 10) % 10
    return laid_out(F.concat(moved, check.cast("string")), value)


def iban(value: Column, key: str) -> Column:
    packed = F.regexp_replace(value, " ", "")
    head, body = F.substr(packed, F.lit(1), F.lit(2)), F.substr(packed, F.lit(5))
    moved = permuted(body, plain_mask(body), key)
    check = F.lit(98) - mod97(F.concat(moved, head, F.lit("00")))
    return laid_out(F.concat(head, F.lpad(check.cast("string"), 2, "0"), moved), value)


def iban_valid(value: Column) -> Column:
    packed = F.regexp_replace(value, " ", "")
    return F.length(packed).between(15, 34) & (mod97(F.concat(F.substr(packed, F.lit(5)), F.substr(packed, F.lit(1), F.lit(4)))) == 1)


def ipv4(value: Column, key: str) -> Column:
    parts = F.split(value, r"\.")
    start = F.struct(F.element_at(parts, 1).cast("int").alias("a"), F.element_at(parts, 2).cast("int").alias("b"), F.element_at(parts, 3).cast("int").alias("c"), F.element_at(parts, 4).cast("int").alias("d"))

    def turn(s: Column, i: Column) -> Column:
        noise = F.sha2(F.concat_ws("|", F.lit(key), *[x.cast("string") for x in (i, s["c"], s["d"])]), 256)
        byte = [F.conv(F.substr(noise, F.lit(at), F.lit(2)), 16, 10).cast("int") for at in (1, 3)]
        return F.struct(s["c"].alias("a"), s["d"].alias("b"), ((s["a"] + byte[0]) % 256).alias("c"), ((s["b"] + byte[1]) % 256).alias("d"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat_ws(".", *[s[x].cast("string") for x in "abcd"]))


def other_day(day: Column, key: str) -> Column:
    """Another of the 17 * 4297 days; the two factors of its number take turns."""
    number = F.datediff(day, F.to_date(F.lit(FIRST_DAY)))
    start = F.struct(F.floor(number / DAYS_RIGHT).cast("long").alias("l"), (number % DAYS_RIGHT).cast("long").alias("r"))

    def noise(i: Column, half: Column) -> Column:
        return F.conv(F.substr(F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), half.cast("string")), 256), F.lit(1), F.lit(12)), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        left = (s["l"] + noise(i * 2, s["r"])) % DAYS_LEFT
        return F.struct(left.alias("l"), ((s["r"] + noise(i * 2 + 1, left)) % DAYS_RIGHT).alias("r"))

    moved = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * DAYS_RIGHT + s["r"])
    return F.date_add(F.to_date(F.lit(FIRST_DAY)), moved.cast("int"))


def in_range(day: Column) -> Column:
    return day.isNotNull() & day.between(F.to_date(F.lit("1900-01-01")), F.to_date(F.lit("2099-12-31")))


def dated(form: str) -> tuple[Callable, Callable]:
    def parse(value: Column) -> Column:
        return F.try_to_timestamp(value, F.lit(form)).cast("date")

    def valid(value: Column) -> Column:
        return in_range(parse(value)) & (F.date_format(parse(value), form) == value)

    return valid, lambda value, key: F.date_format(other_day(parse(value), key), form)


def ssn_valid(value: Column) -> Column:
    return ~value.rlike(r"^(000|666|9\d\d)|-00-|-0000$")


def ssn(value: Column, key: str) -> Column:
    """Permuted again until the number is a possible one, so the possible ones are permuted among themselves."""
    first = permuted(value, plain_mask(value), key)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda v, _: F.when(ssn_valid(v), v).otherwise(permuted(v, plain_mask(v), key)))


def phone(value: Column, key: str) -> Column:
    """Digits after the country code; the first digits of area and exchange of North American numbers stay from 2 to 9."""
    code = F.regexp_extract(value, r"^(\+\d{1,3}(?!\d))", 1)
    code = F.when(value.rlike(r"^\+1\d"), F.lit("+1")).otherwise(code)
    rest = F.substr(value, F.length(code) + 1)
    american = rest.rlike(r"^[ .-]?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}$") & code.isin("", "+1")
    digits = digits_of(rest)
    mask = F.when(american, F.lit("N99N999999")).otherwise(plain_mask(digits))
    return F.concat(code, laid_out(permuted(digits, mask, key), rest))


def mail(value: Column, key: str) -> Column:
    local = F.substring_index(value, "@", 1)
    domain = F.substr(value, F.length(local) + 1)
    moved = F.when(F.length(local) == 1, lone(local, domain, key)).when(local.rlike("^[ -~]*$"), permuted(local, plain_mask(local), key)).otherwise(permuted(local, wide_mask(local), key, ALPHABETS | WIDE))
    return F.concat(moved, domain)


def ipv4_valid(value: Column) -> Column:
    return value.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}$")


def card_valid(value: Column) -> Column:
    return F.length(digits_of(value)).between(13, 19) & (luhn_sum(digits_of(value)) % 10 == 0) & ~digits_of(value).rlike("^0+$")


def phone_valid(value: Column) -> Column:
    return F.length(digits_of(value)).between(8, 15)


#: Kind: (pattern of the whole value, check, pseudonym); the first kind that fits and passes its check is taken.
KINDS: dict[str, tuple[str, Callable, Callable]] = {
    "mail": (MAIL, lambda v: F.lit(True), mail),
    "day_iso": (ISO_DAY, *dated("yyyy-MM-dd")),
    "day_point": (POINT_DAY, *dated("dd.MM.yyyy")),
    "day_slash": (SLASH_DAY, *dated("MM/dd/yyyy")),
    "day_slash_first": (SLASH_DAY, *dated("dd/MM/yyyy")),
    "ipv4": (IPV4, ipv4_valid, ipv4),
    "iban": (IBAN, iban_valid, iban),
    "ssn": (SSN, ssn_valid, ssn),
    "card": (CARD, card_valid, card),
    "phone": (PHONE, phone_valid, phone),
}


ANY_KIND = "^(?:" + "|".join(dict.fromkeys(pattern for pattern, _, _ in KINDS.values())) + ")$"


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; null if it passes no check."""
    out = F.lit(None).cast("string")
    for kind, (pattern, valid, change) in reversed(KINDS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$") & valid(value), change(value, f"{key}|{kind.partition('_')[0]}")).otherwise(out)
    return out


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_fit(spans: Column, key: str) -> Column:
    """The first span that a kind fits and its pseudonym; empty texts if there is none."""
    none = F.struct(F.lit("").alias("old"), F.lit("").alias("new"))

    def tried(v: Column) -> Column:
        return bound(pseudonym(v, key), lambda n: F.when(n.isNull(), none).otherwise(F.struct(v.alias("old"), n.alias("new"))))

    return F.aggregate(F.filter(spans, lambda v: v.rlike(ANY_KIND)), none, lambda a, v: F.when(a["old"] != "", a).otherwise(tried(v)))


def replaced(run: Column, key: str) -> Column:
    """The run with its values replaced, and their number: at each start the found span, or the longest shorter one that fits.

    Shorter spans end where a word ends. Where none fits, the search goes on behind the first word of the span. The pieces are
    joined at the end. Finding its place and carrying the pieces costs a step more the further it stands in a run.
    """
    start = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("n"), F.lit(1).alias("at"), F.lit(True).alias("free"))

    def turn(s: Column, _: Column) -> Column:
        held = F.lpad(F.substr(run, F.greatest(s["at"] - 2, F.lit(1)), F.least(s["at"] - 1, F.lit(2))), 2, " ")
        view = F.struct(F.substr(run, s["at"], F.lit(WINDOW)).alias("rest"), F.when(s["free"], F.lit("  ")).otherwise(held).alias("before"))
        return bound(view, lambda w: F.when(w["rest"] == "", s).otherwise(bound(F.regexp_extract(F.concat(w["before"], w["rest"]), rf"(?s)^..({FOUND})", 1), lambda v: put(s, w["rest"], v))))

    def put(s: Column, rest: Column, v: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(LONGEST), F.lit(SHORTEST), F.lit(-1)), lambda i: i <= F.length(rest))
        ends = F.filter(sizes, lambda i: F.substr(rest, i, F.lit(2)).rlike("^[A-Za-z0-9)](?![A-Za-z0-9])"))
        spans = F.concat(F.array(v), F.transform(ends, lambda i: F.substr(rest, F.lit(1), i)))
        fit = F.when(v == "", F.struct(F.lit("").alias("old"), F.lit("").alias("new"))).otherwise(first_fit(spans, key))
        word = F.when(v == "", F.regexp_extract(rest, r"(?s)^(?:[A-Za-z0-9]+|.)", 0)).otherwise(F.regexp_extract(rest, r"^[+(]*(?:[A-Za-z0-9]+|[^\s])[ /-]?", 0))

        def taken(f: Column) -> Column:
            fell = f["old"] == ""
            return F.struct(
                F.concat(s["pieces"], F.array(F.when(fell, word).otherwise(f["new"]))).alias("pieces"), (s["n"] + F.when(fell, 0).otherwise(1)).alias("n"),
                (s["at"] + F.length(F.when(fell, word).otherwise(f["old"]))).alias("at"), (fell & (v != "")).alias("free"),
            )

        return bound(fit, taken)

    words = F.size(F.regexp_extract_all(run, F.lit(r"(?s)[A-Za-z0-9]+|."), F.lit(0)))
    return F.aggregate(F.sequence(F.lit(1), words), start, turn, lambda s: F.struct(F.array_join(s["pieces"], "").alias("text"), s["n"].alias("n")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The columns of docs with all found values of text replaced, and n_pseudonyms, the number of values replaced."""
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    between = F.split(text, RUN, -1)
    names = F.transform("_runs", lambda r: r["text"])
    woven = F.array_join(F.flatten(F.zip_with(between, F.concat(names, F.array(F.lit(""))), lambda b, n: F.array(b, n))), "")
    held = F.when(text.rlike(r"[0-9@]"), found).otherwise(F.array().cast("array<string>"))
    worked = packed(docs, "text", held.alias("_found")).withColumn("_runs", F.transform("_found", lambda v: replaced(v, key)))
    changed = F.aggregate("_runs", F.lit(0), lambda a, r: a + r["n"])
    rest = docs.select(*[f"`{c}`" for c in docs.columns if c != "n_pseudonyms"])
    return worked.select(
        *unpacked(rest, text=F.when(F.size("_runs") > 0, woven).otherwise(text)),
        F.coalesce(changed, F.lit(0)).cast("long").alias("n_pseudonyms"),
    )
