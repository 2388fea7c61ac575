"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted by a keyed Feistel network.

DataFrame functions only. A value's pseudonym depends on the key and the value alone, so equal values stay linked
across documents, and the permutation of each format is one to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key to use where none is given: for tests. Whoever knows the key can undo the pseudonyms.
KEY = "maskspark-demo-key"
ROUNDS = 8
#: Characters of a half that one SHA-512 moves, by 4 hex digits each.
DRAWN = 32

#: Days from 1800-01-01 to 2199-12-31: 400 years, 189 * 773 days.
_YEARS, _FIRST, _A, _B = (1800, 2199), "1800-01-01", 189, 773

# One alternative a kind, tried in this order at each place. No value starts or ends inside a longer run of its own signs.
# A phone has 8 to 15 digits (looked back at from its end), so that it gives back groups beyond them; it doesn't go on
# with a group after a space that opens another value, unless it would be none without. Digits in groups are taken as one
# run of any length, whose values _in_run() finds.
_OPEN, _SHUT = r"(?<![0-9A-Za-z])(?<![0-9][.\-/])", r"(?![0-9A-Za-z])(?![.\-/][0-9])"
_DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})"
_SSN, _IPV4 = r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
#: Groupings of cards; the long ones have more digits than a phone can have after its country code.
_LONG_CARD = "|".join(f"[0-9]{{4}}{s}[0-9]{{4}}{s}[0-9]{{4}}{s}[0-9]{{4}}(?:{s}[0-9]{{3}})?(?![0-9])|[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{5}}(?![0-9])" for s in (" ", "-"))
_CARD = "|".join([_LONG_CARD, "[0-9]{13,19}(?![0-9])", *(f"[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{4}}(?![0-9])|[0-9]{{4}}{s}[0-9]{{3}}{s}[0-9]{{3}}{s}[0-9]{{3}}(?![0-9])" for s in (" ", "-"))])


def _after(least: int) -> str:
    """Here end `least` to 15 digits of a phone."""
    return r"(?<=\+" + r"[ .\-()]{0,2}[0-9]" * least + r"(?:[ .\-()]{0,2}[0-9])?" * (15 - least) + ")"


# four groups of four may be the end of the phone and the start of a card: a fifth tells, or that the phone is long enough
_NO_CARD = rf"(?! (?:{_CARD})(?! [0-9]{{4}}(?![0-9])))(?!{_after(10)} (?:{_CARD}))"
_NO_LONG = rf"(?! (?:{_LONG_CARD})(?! [0-9]{{4}}(?![0-9])))"
_NO_OTHER = rf"(?! (?:{_DATE}|{_SSN}|{_IPV4})(?![0-9])){_NO_CARD}"
_PHONE_OPEN, _PHONE_SHUT = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .\-]?\([0-9]{2,4}\))?", r"(?![0-9A-Za-z])" + _after(8)
_GROUP = r"[ .\-]?[0-9]{2,5}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*+\.)++[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])",
    "phone": _PHONE_OPEN + rf"{_NO_LONG}{_GROUP}(?:{_NO_OTHER}{_GROUP}){{1,4}}" + _PHONE_SHUT + "|" + _PHONE_OPEN + rf"{_NO_LONG}{_GROUP}(?:{_NO_CARD}{_GROUP}){{1,4}}" + _PHONE_SHUT + r"(?![.\-/][0-9])",
    "ipv4": _OPEN + _IPV4 + _SHUT,
    "date": _OPEN + _DATE + _SHUT,
    "ssn": _OPEN + _SSN + _SHUT,
    "digits": _OPEN + r"[0-9][0-9 \-]{11,}[0-9]" + _SHUT + r"(?![A-Za-z0-9._%+\-]*+@)",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _hex(s: Column) -> Column:
    return F.conv(s, 16, 10).cast("long")


def _kind_of(char: Column) -> Column:
    """First sign and size of the character's class: 48 and 10 for digits, 65 or 97 and 26 for letters, and 1 for others."""
    code = F.ascii(char)
    return (
        F.when(code.between(48, 57), F.struct(F.lit(48).alias("base"), F.lit(10).alias("size")))
        .when(code.between(65, 90), F.struct(F.lit(65).alias("base"), F.lit(26).alias("size")))
        .when(code.between(97, 122), F.struct(F.lit(97).alias("base"), F.lit(26).alias("size")))
        .otherwise(F.struct(code.alias("base"), F.lit(1).alias("size")))
    )


def _hex_kind(char: Column) -> Column:
    return F.struct(F.lit(0).alias("base"), F.lit(16).alias("size"))


def _network(text: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """A string of the same length and the same class at each place: digits for digits, letters for letters.

    The two halves take turns: to each character of one half a number drawn from the other half is added within its class.
    """
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))

    def turned(a: Column, b: Column, n: Column) -> Column:
        """a, each of its characters moved by what b draws in round n."""
        base = F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), F.length(a).cast("string"), b)
        further = F.transform(F.sequence(F.lit(1), F.floor((F.length(a) - 1) / DRAWN).cast("int")), lambda k: F.sha2(F.concat_ws("|", base, k.cast("string")), 512))
        stream = F.when(F.length(a) <= DRAWN, F.sha2(base, 512)).otherwise(F.concat(F.sha2(base, 512), F.array_join(further, "")))

        def moved(char: Column, i: Column) -> Column:
            by = _hex(F.substring(stream, i * 4 + 1, F.lit(4)))
            if hexadecimal:
                return F.lower(F.hex(F.pmod(_hex(char) + by, F.lit(16)).cast("long")))
            c = _kind_of(char)
            value = F.ascii(char) - c["base"]
            return F.char((c["base"] + F.pmod(value + by, c["size"])).cast("int"))

        return F.array_join(F.transform(F.filter(F.split(a, ""), lambda x: x != ""), moved), "")

    def one_round(state: Column, n: Column) -> Column:
        even = n % 2 == 0
        return F.struct(
            F.when(even, turned(state["l"], state["r"], n)).otherwise(state["l"]).alias("l"),
            F.when(even, state["r"]).otherwise(turned(state["r"], state["l"], n)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one_round, lambda s: F.concat(s["l"], s["r"]))


def _number(value: Column, a: int, b: int, key: str, kind: str | Column) -> Column:
    """A permutation of the whole numbers from 0 to a * b - 1, another one for each kind."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    start = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).cast("long").alias("r"))
    drawn = lambda n, x: _hex(F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, n.cast("string"), x.cast("string")), 256), 1, 14))

    def one_round(s: Column, n: Column) -> Column:
        even = n % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + drawn(n, s["r"]), F.lit(a))).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + drawn(n, s["l"]), F.lit(b))).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one_round, lambda s: s["l"] * b + s["r"])


def _luhn_digit(body: Column) -> Column:
    """The digit that makes body valid."""
    digits = F.reverse(F.transform(F.filter(F.split(body, ""), lambda x: x != ""), lambda x: x.cast("int")))
    weighed = F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return ((10 - F.aggregate(weighed, F.lit(0), lambda x, y: x + y) % 10) % 10).cast("string")


def _laid_out(digits: Column, like: Column) -> Column:
    """digits with the separators of `like` put back."""
    signs = F.filter(F.split(like, ""), lambda x: x != "")
    placed = F.aggregate(
        signs, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike("[0-9]"), F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + F.when(c.rlike("[0-9]"), 1).otherwise(0)).cast("int").alias("at"),
        ),
    )
    return placed["out"]


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    body = _network(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return F.when(F.call_function("luhn_check", digits), F.transform(F.array(body), lambda b: _laid_out(F.concat(b, _luhn_digit(b)), m))[0])


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, "[.]"), lambda x: x.cast("long"))
    valid = F.forall(octets, lambda x: x <= 255)
    new = F.transform(F.array(_number(F.aggregate(octets, F.lit(0).cast("long"), lambda a, b: a * 256 + b), 1 << 16, 1 << 16, key, "ipv4")), lambda x: F.array_join(
        F.transform(F.array(*[F.lit(s) for s in (24, 16, 8, 0)]), lambda s: F.pmod(F.floor(x / F.pow(F.lit(2.0), s)), F.lit(256)).cast("long").cast("string")), "."))[0]
    return F.when(valid, new)


def _date(m: Column, key: str) -> Column:
    """Year first, or day first; month first where only that gives a date. Days outside 1800 to 2199 are left alone.

    Days are permuted by number and written as they were read. A date that only reads with its month first gets one of the
    kind: its day is permuted again and again until it is over 12, which keeps the permutation one to one.
    """
    sep = F.regexp_extract(m, "([-/.])", 1)
    written = lambda a, b, c: F.concat(F.lit(a), sep, F.lit(b), sep, F.lit(c))
    year_first = m.rlike("^[0-9]{4}")
    first = F.when(year_first, written("yyyy", "MM", "dd")).otherwise(written("dd", "MM", "yyyy"))
    read = lambda fmt: F.try_to_timestamp(m, fmt).cast("date")
    other = F.when(~year_first & (sep != "."), written("MM", "dd", "yyyy"))
    readings = F.array(F.struct(read(first).alias("day"), first.alias("fmt"), F.lit(False).alias("late")), F.struct(read(other).alias("day"), other.alias("fmt"), F.lit(True).alias("late")))

    def new(r: Column) -> Column:
        date = lambda n: F.date_add(F.lit(_FIRST).cast("date"), n.cast("int"))
        moved = lambda n: _number(n, _A, _B, key, F.concat(F.lit("date "), r["fmt"]))
        start = moved(F.datediff(r["day"], F.lit(_FIRST).cast("date")).cast("long"))
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, lambda n, _: F.when(F.dayofmonth(date(n)) <= 12, moved(n)).otherwise(n))
        return F.when(F.year(r["day"]).between(*_YEARS), F.call_function("date_format", date(F.when(r["late"], walked).otherwise(start)), r["fmt"]))

    return F.get(F.transform(F.filter(readings, lambda r: r["day"].isNotNull()), new), 0)


def _ssn(m: Column, key: str) -> Column:
    """Permuted again and again until it is valid once more, which keeps the permutation one to one."""
    valid = lambda x: ~x.rlike("^(?:000|666|9)|-00-|-0000$")
    first = F.struct(_network(m, key, "ssn").alias("v"))
    again = F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, lambda s, _: F.struct(F.when(valid(s["v"]), s["v"]).otherwise(_network(s["v"], key, "ssn")).alias("v")))
    return F.when(valid(m), again["v"])


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of a value that PATTERN matched; null if it isn't valid.

    Cards have 13 to 19 digits and a right check digit, and get a right one again; dates are in the calendar; IPv4 octets
    are at most 255; social security numbers have an area, a group and a serial that are given out; a phone number has a
    country code, which stays, and 8 to 15 digits; of an e-mail address the local part is permuted; a secret is a
    hexadecimal key of 32, 40 or 64 digits.
    """
    at = F.instr(m, "@")
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    code = F.regexp_extract(m, r"^(\+1(?=[^0-9]|[0-9]{10}$)|\+[0-9]{1,3}(?=[ .(\-])|\+[0-9]{2})", 1)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return (
        F.when(at > 0, F.concat(_network(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m))))
        .when(m.startswith("+"), F.when(digits.between(8, 15), F.concat(code, _network(rest, key, "phone"))))
        .when(m.rlike(r"^[0-9a-f]{32}([0-9a-f]{8}|[0-9a-f]{32})?$"), _network(m, key, "secret", hexadecimal=True))
        .when(m.rlike(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$"), _ipv4(m, key))
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(m, key))
        .when(m.rlike(r"^([0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})$"), _date(m, key))
        .when(digits.between(13, 19), _card(m, key))
    )


def _in_run(run: Column, key: str) -> Column:
    """(text, n): a run of digits, blanks and dashes with its n values replaced.

    From the left, each group of digits opens the longest card in one of the usual groupings, date or social security number
    that is valid. Of what is left between them, 13 to 19 digits with a right check digit are a card in any grouping.
    """
    tokens = F.regexp_extract_all(run, F.lit("[0-9]+|[ -]+"), 0)

    def at(i: Column, tokens: Column) -> Column:
        """(j, v) of the longest value from token i to token j, or null."""

        def upto(j: Column) -> Column:
            t = F.array_join(F.slice(tokens, i + 1, j - i + 1), "")
            apart = ~F.coalesce((F.get(tokens, i - 1) == "-") | (F.get(tokens, j + 1) == "-"), F.lit(False))
            small = F.when(apart & t.rlike(f"^{_SSN}$"), _ssn(t, key)).when(apart & t.rlike(f"^{_DATE}$"), _date(t, key))
            return F.struct(j.alias("j"), F.when(t.rlike(f"^(?:{_CARD})$"), _card(t, key)).otherwise(small).alias("v"))

        # nine tokens: five groups
        ends = F.sequence(F.least(i + 8, F.size(tokens) - 1), i, F.lit(-1))
        return F.get(F.filter(F.transform(ends, upto), lambda c: c["v"].isNotNull()), 0)

    def part(text: Column, done: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(done).alias("done"))

    def step(s: Column, i: Column, tokens: Column) -> Column:
        def taken(hit: Column) -> Column:
            new = F.concat(s["parts"], F.array(part(s["clear"], False), part(hit["v"], True)))
            return F.when(hit.isNotNull(), F.struct((hit["j"] + 1).alias("next"), F.lit("").alias("clear"), new.alias("parts"))).otherwise(
                F.struct(s["next"].alias("next"), F.concat(s["clear"], F.get(tokens, i)).alias("clear"), s["parts"].alias("parts")))

        opens = F.get(tokens, i).rlike("^[0-9]")
        return F.when(i < s["next"], s).otherwise(F.transform(F.array(F.when(opens, at(i, tokens))), taken)[0])

    def read(tokens: Column) -> Column:
        start = F.struct(F.lit(0).alias("next"), F.lit("").alias("clear"), F.array().cast("array<struct<text:string,done:boolean>>").alias("parts"))
        return F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), start, lambda s, i: step(s, i, tokens), lambda s: F.concat(s["parts"], F.array(part(s["clear"], False))))

    def free(p: Column) -> Column:
        new = F.when(~p["done"] & F.length(F.regexp_replace(p["text"], "[^0-9]", "")).between(13, 19), _card(p["text"], key))
        return F.transform(F.array(new), lambda v: F.struct(F.coalesce(v, p["text"]).alias("text"), (p["done"] | v.isNotNull()).alias("done")))[0]

    whole = lambda parts: F.struct(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.size(F.filter(parts, lambda p: p["done"])).alias("n"))
    return F.transform(F.transform(F.transform(F.array(tokens), read), lambda parts: F.transform(parts, free)), whole)[0]


def _replaced(m: Column, key: str) -> Column:
    """(text, n): a match of PATTERN with its n values replaced."""
    one = F.transform(F.array(pseudonym(m, key)), lambda v: F.struct(F.coalesce(v, m).alias("text"), F.when(v.isNotNull(), 1).otherwise(0).alias("n")))[0]
    return F.when(m.rlike("^[0-9][0-9 -]{11,}[0-9]$") & ~m.rlike("^([0-9]{32}|[0-9]{40}|[0-9]{64})$"), _in_run(m, key)).otherwise(one)


def pseudonymize(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_pseudonyms") -> DataFrame:
    """docs with the personal values in `text_col` replaced, and `count_col` long: how many were.

    Null texts stay null with a count of 0, empty ones empty; texts of any length are taken whole; repeated rows and
    repeated values get the same pseudonyms; a column `count_col` that is there already is replaced, others pass
    through. Values that fail their check stay as they are. No rows give no rows.
    """
    names = [c for c in docs.columns if c != count_col]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)])
    text = F.col(f"__c{names.index(text_col)}").cast("string")
    wide = inner.withColumn("__found", F.regexp_extract_all(text, F.lit(PATTERN), 0))
    wide = wide.withColumn("__new", F.transform("__found", lambda m: _replaced(m, key)))
    pieces = F.split(text, PATTERN, -1)
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get("__new", i)["text"], F.lit("")))), "")
    out = F.when(F.size("__found") > 0, joined).otherwise(text)
    count = F.coalesce(F.aggregate("__new", F.lit(0), lambda n, x: n + x["n"]), F.lit(0)).cast("long")
    return wide.select(*[(out if c == text_col else F.col(f"__c{i}")).alias(c) for i, c in enumerate(names)], count.alias(count_col))
