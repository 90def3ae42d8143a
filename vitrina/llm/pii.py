"""Format-preserving pseudonyms of personal numbers and dates, in DataFrame functions only.

One pattern finds candidates; a candidate is validated by its kind and, if valid, permuted by a keyed Feistel network within
the values of its format, so that equal values stay equal everywhere and different ones stay different:

- card numbers: 13 to 19 digits with a right Luhn check digit; the digits before it are permuted, the check digit follows. Groups
  of digits one space or hyphen apart form a run of any length: if it is no card as a whole, usual card layouts anywhere in it
  come first, then other values, then the longest card from each group on, so that neighbouring numbers hide none;
- phone numbers: three, three and four digits, with or without +1, or ten digits in a row from 2 on (seconds since 1970 begin
  with 1); the ten digits are permuted (North American area and exchange codes stay such codes);
- international phone numbers, + and eight digits or more with a country code other than 1: the digits after the code are permuted,
  so a number is the same value however it is grouped;
- IPv4 addresses; social security numbers (valid areas, groups and serials); dates 1800 to 2199 as yyyy-mm-dd (also before a
  time, as in 2024-01-05T10:00) or dd/mm/yyyy. With more than 12 in the place of the month, a date is read and written as
  mm/dd/yyyy; its pseudonym is that of the same day in the other layouts, so its text can equal that of a day-first date.

Separators stay where they are. E-mail addresses have no numeric domain: their local part becomes a keyed hash.

A network mixes a pair (l, r) of residues modulo A and B in eight rounds, each adding a keyed hash of one half to the other;
every round can be undone, so the whole is a permutation of the A * B values.

Defined cases: NULL stays NULL with 0 counts, an empty text stays empty; invalid candidates stay; very long texts are worked
through whole; rows are independent, so repeated rows get the same result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "phone", "world", "ip", "date", "ssn", "card")
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}"
PHONE = r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|(?:\+1)?[2-9]\d{9}"
# Country codes of one and two digits; all others have three.
COUNTRY = r"^(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
# Starts of other values, which a number before them does not take in: cards, phones, dates, security numbers.
START = r"\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]|\d{3}[ .-]\d{3}[ .-]\d{4}|\d{4}-\d\d-\d\d|\d{3}-\d\d-\d{4}|\d\d/\d\d/\d{4}"
WORLD = rf"\+[2-9]\d{{0,3}}(?:[ .-]?\(\d{{1,4}}\))?(?:[ .-]?(?!{START})\d{{1,7}}(?!\d)){{1,4}}|\+[2-9]\d{{7,14}}"
IP = r"\d{1,3}(?:\.\d{1,3}){3}"
DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
LAYOUT = r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5}|\d{13,19}"  # of cards
STAMP = r"\d{4}-\d{2}-\d{2}(?=T\d\d:\d)"  # a date that a time follows
# Groups that are no part of a word, a decimal or a date; possessive, so that a long run neither backtracks nor recurses.
GROUP = r"\d++(?!\w|\.\d)"
RUN = rf"(?=\d(?:[ -]?\d){{12}}){GROUP}(?:[ -](?!\d\d/\d\d/\d{{4}}(?!\w)|{STAMP}){GROUP})*+"
OTHER = rf"(?<![\w.+-])(?:{PHONE}|{DATE}|{SSN})(?!\w|[.-]\d)"  # kinds that can lie within a run
ANY = rf"{EMAIL}|(?<![\w.+-])(?:(?:{PHONE}|{WORLD}|{IP}|{DATE}|{SSN}|{RUN})(?!\w|[.-]\d)|{STAMP})"
MARKED = "<[^>]*>"
ROUNDS = 8
EPOCH = "1800-01-01"
DAYS = (189, 773)  # 146,097 days are 400 years of the calendar


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _number(value: Column) -> Column:
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def _round_hash(key: str, kind: str, step: Column, half: Column) -> Column:
    """60 bits of a keyed SHA-256."""
    text = F.concat_ws(":", F.lit(key), F.lit(kind), step.cast("string"), half.cast("string"))
    return F.conv(F.substr(F.sha2(text.cast("binary"), 256), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """Keyed permutation of pairs (left < a, right < b), as a struct l, r."""
    a, b = (F.lit(x).cast("bigint") if isinstance(x, int) else x for x in (a, b))

    def step(state, number):
        odd = number % 2 == 1
        return F.struct(
            F.when(odd, state["l"]).otherwise(F.pmod(state["l"] + _round_hash(key, kind, number, state["r"]) % a, a)).alias("l"),
            F.when(odd, F.pmod(state["r"] + _round_hash(key, kind, number, state["l"]) % b, b)).otherwise(state["r"]).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), step)


def _lay(token: Column, digits: Column) -> Column:
    """The digits of a token replaced one by one; everything else stays."""

    def put(at):
        here = F.substr(token, at, F.lit(1))
        number = F.length(_digits(F.substr(token, F.lit(1), at)))
        return F.when(here.rlike(r"^\d$"), F.substr(digits, number, F.lit(1))).otherwise(here)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(token)), put), "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right (beginning with the last but one) doubled and reduced."""
    n = F.length(digits)

    def add(total, at):
        digit = F.substr(digits, n - at, F.lit(1)).cast("int")
        doubled = digit * 2
        return total + F.when(at % 2 == 1, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _padded(value: Column, width) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once and written once: repeated expressions would multiply in the plan."""
    return F.transform(F.array(value), use)[0]


def _card(token: Column, key: str) -> Column:
    def permuted(f):
        digits, high, low = f["digits"], f["high"], f["low"]
        left, right = _number(F.substr(digits, F.lit(1), high)), _number(F.substr(digits, high + 1, low))
        ten = lambda width: F.round(F.pow(F.lit(10.0), width)).cast("bigint")

        def written(mixed):
            body = F.concat(_padded(mixed["l"], high), _padded(mixed["r"], low))
            return _let(body, lambda x: F.concat(x, ((F.lit(10) - _luhn(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))

        sized = F.struct(ten(high).alias("a"), ten(low).alias("b"))
        new = _let(sized, lambda s: _let(feistel(left, right, s["a"], s["b"], key, "card"), written))
        return F.when(_luhn(digits) % 10 == 0, _lay(token, new))

    digits = _digits(token)
    high = F.floor((F.length(digits) - 1) / 2).cast("int")
    return _let(F.struct(digits.alias("digits"), high.alias("high"), (F.length(digits) - 1 - high).alias("low")), permuted)


def _phone(token: Column, key: str) -> Column:
    def numbered(digits):
        ten = F.right(digits, F.lit(10))
        area, exchange, line = (_number(F.substr(ten, F.lit(p), F.lit(w))).alias(n) for n, p, w in (("area", 1, 3), ("exchange", 4, 3), ("line", 7, 4)))
        lead = F.substr(digits, F.lit(1), F.length(digits) - 10)
        return _let(F.struct(area, exchange, line, lead.alias("lead"), F.substr(ten, F.lit(1), F.lit(6)).alias("codes")), permuted)

    def american(f):
        # 800 area codes by 800 exchanges by 10,000 lines are 80,000 by 80,000.
        value = ((f["area"] - 200) * 800 + (f["exchange"] - 200)) * 10_000 + f["line"]
        mixed = _let(value, lambda v: _let(feistel(F.floor(v / 80_000), v % 80_000, 80_000, 80_000, key, "phone"), lambda m: m["l"] * 80_000 + m["r"]))

        def written(number):
            codes = F.floor(number / 10_000).cast("bigint")
            return F.concat((F.floor(codes / 800) + 200).cast("string"), (codes % 800 + 200).cast("string"), _padded(number % 10_000, 4))

        return _let(mixed, written)

    def permuted(f):
        # Other codes: only the line number is permuted, under its own codes, so both kinds stay apart.
        line = f["line"]
        rest = _let(feistel(F.floor(line / 100), line % 100, 100, 100, key, "line"), lambda m: _padded(m["l"] * 100 + m["r"], 4))
        valid = (f["area"] >= 200) & (f["exchange"] >= 200)
        return _lay(token, F.concat(f["lead"], F.when(valid, american(f)).otherwise(F.concat(f["codes"], rest))))

    return _let(_digits(token), numbered)


def _world(token: Column, key: str) -> Column:
    def permuted(f):
        high, low = F.floor(f["rest"] / 2).cast("int"), (f["rest"] - F.floor(f["rest"] / 2)).cast("int")
        at = F.length(f["code"]) + 1
        left, right = _number(F.substr(f["digits"], at, high)), _number(F.substr(f["digits"], at + high, low))
        ten = lambda width: F.round(F.pow(F.lit(10.0), width)).cast("bigint")
        new = _let(feistel(left, right, ten(high), ten(low), key, "world"), lambda m: F.concat(f["code"], _padded(m["l"], high), _padded(m["r"], low)))
        return F.when(F.length(f["digits"]) >= 8, _lay(token, new))

    digits = _digits(token)
    code = F.regexp_extract(digits, COUNTRY, 0)
    return _let(F.struct(digits.alias("digits"), code.alias("code"), (F.length(digits) - F.length(code)).alias("rest")), permuted)


def _ip(token: Column, key: str) -> Column:
    def permuted(p):
        valid = (p[0] <= 255) & (p[1] <= 255) & (p[2] <= 255) & (p[3] <= 255)
        mixed = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65_536, 65_536, key, "ip")

        def written(m):
            halves = [F.floor(m["l"] / 256), m["l"] % 256, F.floor(m["r"] / 256), m["r"] % 256]
            return F.concat_ws(".", *[h.cast("string") for h in halves])

        return F.when(valid, _let(mixed, written))

    return _let(F.transform(F.split(token, r"\."), _number), permuted)


def _date(token: Column, key: str) -> Column:
    iso = F.substr(token, F.lit(5), F.lit(1)) == "-"
    year, month, day = F.substr(token, F.lit(7), F.lit(4)), F.substr(token, F.lit(4), F.lit(2)), F.substr(token, F.lit(1), F.lit(2))
    american = ~iso & (month > "12")
    written = F.when(iso, token).when(american, F.concat_ws("-", year, day, month)).otherwise(F.concat_ws("-", year, month, day))
    number = F.datediff(written.try_cast("date"), F.lit(EPOCH).cast("date"))
    a, b = DAYS

    def permuted(n):
        new = _let(
            feistel(F.floor(n / b), n % b, a, b, key, "date"),
            lambda m: F.date_add(F.lit(EPOCH).cast("date"), (m["l"] * b + m["r"]).cast("int")),
        )
        shown = lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(american, F.date_format(d, "MM/dd/yyyy"))
        text = _let(new, lambda d: shown(d).otherwise(F.date_format(d, "dd/MM/yyyy")))
        return F.when(n.between(0, a * b - 1), text)

    return _let(number, permuted)


def _ssn(token: Column, key: str) -> Column:
    def permuted(p):
        area, group, serial = p[0], p[1], p[2]
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        place = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas

        def written(m):
            new = _let(F.floor(m["l"] / 99) + 1, lambda x: F.when(x >= 666, x + 1).otherwise(x))
            return F.concat_ws("-", _padded(new, 3), _padded(m["l"] % 99 + 1, 2), _padded(m["r"] + 1, 4))

        return F.when(valid, _let(feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9_999, key, "ssn"), written))

    return _let(F.transform(F.split(token, "-"), _number), permuted)


def _email(token: Column, key: str) -> Column:
    local, domain = F.split_part(token, F.lit("@"), F.lit(1)), F.split_part(token, F.lit("@"), F.lit(2))
    hashed = F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(local), F.lower(domain)).cast("binary"), 256)
    return F.concat(F.lit("u"), F.substr(hashed, F.lit(1), F.lit(12)), F.lit("@"), domain)


def _kind(token: Column) -> Column:
    out = F.lit("email")
    for kind, pattern in (("card", r"\d[\d -]*"), ("ssn", SSN), ("date", DATE), ("ip", IP), ("world", WORLD), ("phone", PHONE)):
        out = F.when(token.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _replaced(text: Column, pattern: str, use) -> Column:
    """The text with `use(match)` in place of every match of the pattern."""
    found, between = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), use), F.split(text, pattern, -1)
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _outside(text: Column, use) -> Column:
    """The text with `use(part)` in place of every part that is not marked."""
    found, between = F.regexp_extract_all(text, F.lit(MARKED), F.lit(0)), F.transform(F.split(text, MARKED, -1), use)
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _marked_cards(part: Column, layout: str, key: str) -> Column:
    """Part of a run with pseudonyms, marked, for the cards of whole groups in a layout: from left to right, the longest first."""

    def at(groups, start):
        """Number of groups and text of the card that starts here; NULL without one."""

        def among(near):
            def window(k):
                text = F.regexp_replace(F.array_join(F.slice(near, F.lit(1), k), ""), "[ -]$", "")
                return _let(text, lambda t: F.when(t.rlike(f"^(?:{layout})$"), F.when(_luhn(_digits(t)) % 10 == 0, F.struct(k.alias("k"), t.alias("text")))))

            return F.filter(F.transform(F.sequence(F.size(near), F.lit(1), F.lit(-1)), window), lambda w: w.isNotNull())

        near = F.sequence(start, F.least(start + 18, F.size(groups)))  # a group has one digit at least
        return _let(F.transform(near, lambda k: F.get(groups, k - 1)), among)

    def marked(groups):
        def step(state, start):
            def put(found):
                card = F.get(found, F.lit(0))
                end = F.regexp_extract(F.get(groups, start + card["k"] - 2), "[ -]$", 0)
                return F.when(F.size(found) > 0, F.struct(
                    (start + card["k"]).alias("next"), F.concat(state["out"], F.lit("<"), _card(card["text"], key), F.lit(">"), end).alias("out"),
                )).otherwise(F.struct((start + 1).alias("next"), F.concat(state["out"], F.get(groups, start - 1)).alias("out")))

            return F.when(start < state["next"], state).otherwise(_let(at(groups, start), put))

        start = F.struct(F.lit(1).alias("next"), F.lit("").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, lambda state: state["out"])

    return _let(F.split(part, r"(?<=[ -])", -1), marked)


def _made(kind: Column, value: Column, key: str, makers: dict) -> Column:
    """The pseudonym of a value by its kind; NULL if it is not valid."""
    new = F.lit(None).cast("string")
    for name, maker in makers.items():
        new = F.when(kind == name, maker(value, key)).otherwise(new)
    return new


def _cards_in(layout: str, key: str):
    enough = r"\d(?:[ -]?\d){12}"
    return lambda text: _outside(text, lambda part: F.when(part.rlike(enough), _marked_cards(part, layout, key)).otherwise(part))


def _others_in(key: str):
    makers = {"phone": _phone, "date": _date, "ssn": _ssn}

    def put(value):
        return F.coalesce(F.concat(F.lit("<"), _made(_kind(value), value, key, makers), F.lit(">")), value)

    return lambda text: _outside(text, lambda part: _replaced(part, OTHER, put))


def _in_runs(step) -> Column:
    return F.transform("__changed", lambda c: F.when(c["run"], F.struct(step(c["text"]).alias("text"), c["n"].alias("n"), c["run"].alias("run"))).otherwise(c))


def _pseudonym(token: Column, key: str) -> Column:
    """Struct text, n (values replaced) and run (whether values are still to be looked for in it)."""
    makers = {"email": _email, "phone": _phone, "world": _world, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card}

    def chosen(kind):
        fits = (kind != "card") | F.length(_digits(token)).between(13, 19)
        return _let(F.when(fits, _made(kind, token, key, makers)), lambda new: F.struct(
            F.coalesce(new, token).alias("text"), new.isNotNull().cast("int").alias("n"), (new.isNull() & (kind == "card")).alias("run"),
        ))

    return _let(_kind(token), chosen)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count_name: str = "n_private") -> DataFrame:
    """The documents with pseudonyms in `text`, and the number of values replaced in the column `count_name`."""
    source = F.col(text)
    maybe = F.coalesce(source.rlike("@|[0-9](?:[ ./-]?[0-9]){3}"), F.lit(False))  # what every pattern holds
    none = F.array().cast("array<string>")
    tokens = F.when(maybe, F.regexp_extract_all(source, F.lit(ANY), F.lit(0))).otherwise(none)
    changed = F.transform(tokens, lambda token: _pseudonym(token, key))
    rows = docs.withColumn("__changed", changed)
    # A step a column: nested in one expression they would be too deep for the analyser.
    for step in (_cards_in(LAYOUT, key), _others_in(key), _cards_in(r"\d(?:[ -]?\d){12,18}", key)):
        rows = rows.withColumn("__changed", _in_runs(step))
    marks = lambda c: F.size(F.regexp_extract_all(c["text"], F.lit("<"), F.lit(0)))
    rows = rows.withColumn("__changed", F.transform("__changed", lambda c: F.when(
        c["run"], F.struct(F.translate(c["text"], "<>", "").alias("text"), marks(c).alias("n"), c["run"].alias("run"))
    ).otherwise(c)))
    between = F.split(source, ANY, -1)
    whole = F.array_join(F.zip_with(between, F.transform("__changed", lambda c: c["text"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    count = F.aggregate("__changed", F.lit(0), lambda total, c: total + c["n"])
    return rows.withColumns({
        text: F.when(F.size("__changed") > 0, whole).otherwise(source), count_name: F.coalesce(count, F.lit(0)).cast("long"),
    }).drop("__changed")
