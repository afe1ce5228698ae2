"""Format-preserving pseudonyms for personal numbers, dates, addresses and keys.

Every value found is validated (check digits, calendar, octets, area codes) and permuted within its own
format by a keyed Feistel network: payment cards and account numbers keep length, separators and a
right check digit, dates stay dates in their notation, network addresses stay addresses, and telephone
numbers keep their country code and stay dialable.  Where a match fails its check, the shorter lengths at its group borders are tried, and an account number's
length is its country's.  The permutation depends on the value, its kind and
the key alone, so equal values stay linked across documents and different ones stay different.  Whatever
fails its validation stays as it is, and so do dates before 1900 or after about 2099.  A slash date is day first where that can
be; one that can only be month first stays such a one, so the two readings never meet.  A network address
with leading zeros is the same address without.  All of it is DataFrame functions, linear in a value's length; texts without a
digit, an at sign or a key word are passed by after one look.

Cases: a null text stays null with zero counts, an empty one stays empty; repeated rows get the same
text; null ids stay null; very long texts are rewritten whole; an empty table gives an empty
result; extra columns are kept as they are, and those with the names of counts are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import unused

KEY = "leafmill-demo-key"
ROUNDS = 8
#: Alphabets by the letter of a mask; k keeps the character.
_ALPHABETS = {"d": "0123456789", "n": "23456789", "h": "0123456789abcdef", "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Days from 1900-01-01 that dates are permuted among, as 270 x 271; of days from the 13th of a month on, 210 x 210.
_DAY_SIDES, _LATE_SIDES = (270, 271), (210, 210)
#: Country calling codes of one and two digits; all others have three.
_CODES = {
    1: "1 7",
    2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98",
}
#: Characters of an account number by country; those of other countries are tried at their group borders.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_COUNTRY = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _LENGTHS.items())
#: Kinds in the order in which they are tried; each pattern takes a whole value, that of cards a whole run of groups.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:password|passwd|pwd|secret|token|api_?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9+/_-]{8,}[\"']?",
    "account": rf"(?<![A-Za-z0-9])(?:{_BY_COUNTRY}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "address": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "person": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+(?!1[ (.-])[0-9]{1,3}(?:[ -]?\(?[0-9]{1,4}\)?){2,5}(?![0-9]|\.[0-9])|(?<![0-9-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])(?<![0-9][.-])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?!\.[0-9])(?:[ -][0-9]++(?!\.[0-9]))*+",
}
COUNTS = tuple(f"n_{kind}" for kind in PATTERNS)
#: Cards are looked for in what the other kinds leave, so that a run of groups doesn't take their values in.
_ANY = "|".join(p for kind, p in PATTERNS.items() if kind != "card")
_WORTH_A_LOOK = r"[0-9@]|(?i:pass|pwd|secret|token|key)"


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _at(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("bigint")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _of_mask(m: Column, each, kept: Column) -> Column:
    """each(alphabet) for the alphabet that the mask's letter m names, kept where there is none."""
    return reduce(lambda e, k: e.when(m == k, each(_ALPHABETS[k])), _ALPHABETS, F.when(F.lit(False), kept)).otherwise(kept)


def _shifted(side: Column, sizes: Column, other: Column, salt: Column) -> Column:
    """Each number of side moved modulo its size by 16 bits of a digest of the other side; a digest serves 32 numbers."""

    def digests(text: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(side) - 1) / 32).cast("int")), lambda n: F.sha2(F.concat_ws("|", salt, n.cast("string"), text), 512))

    def move(found: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            step = _number(F.substring(F.get(found, F.floor(i / 32).cast("int")), (i % 32) * 4 + 1, F.lit(4)))
            return F.pmod(x + step, F.get(sizes, i)).cast("int")

        return F.transform(side, one)

    return F.when(F.size(side) == 0, side).otherwise(_let(_let(F.array_join(other, ","), digests), move))


def feistel(s: Column, mask: Column, kind: str, key: str) -> Column:
    """The characters of s as an array, each permuted within the alphabet that mask names for its place.  A bijection for each mask.
    Every part is bound once, so the cost is linear in the length."""

    def halves(p: Column) -> Column:
        half = F.floor(F.size(p["c"]) / 2).cast("int")
        place = F.zip_with(p["c"], p["m"], lambda c, m: _of_mask(m, lambda a: F.instr(F.lit(a), c) - 1, F.lit(0)))
        sizes = F.transform(p["m"], lambda m: _of_mask(m, lambda a: F.lit(len(a)), F.lit(1)))
        return _let(
            F.struct(place.alias("v"), sizes.alias("n"), half.alias("h")),
            lambda q: F.struct(*(F.slice(q[x], F.lit(1) if first else q["h"] + 1, q["h"] if first else F.size(q[x]) - q["h"]).alias(x + str(int(first))) for x in "vn" for first in (True, False))),
        )

    def rounds(p: Column, q: Column) -> Column:
        def one(st: Column, r: Column) -> Column:
            salt = F.concat_ws("|", F.lit(key), F.lit(kind), F.array_join(p["m"], ""), r.cast("string"))
            return _let(
                salt,
                lambda x: F.struct(
                    F.when(r % 2 == 0, _shifted(st["a"], q["n1"], st["b"], x)).otherwise(st["a"]).alias("a"),
                    F.when(r % 2 == 1, _shifted(st["b"], q["n0"], st["a"], x)).otherwise(st["b"]).alias("b"),
                ),
            )

        done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(q["v1"].alias("a"), q["v0"].alias("b")), one)
        return _let(done, lambda st: F.concat(st["a"], st["b"]))

    def back(p: Column, v: Column) -> Column:
        both = F.zip_with(p["c"], p["m"], lambda c, m: F.struct(c.alias("c"), m.alias("m")))
        return F.zip_with(both, v, lambda z, x: _of_mask(z["m"], lambda a: _at(F.lit(a), x + 1), z["c"]))

    parts = F.struct(_chars(s).alias("c"), _chars(mask).alias("m"))
    return _let(parts, lambda p: _let(halves(p), lambda q: _let(rounds(p, q), lambda v: back(p, v))))


def feistel_number(x: Column, sides: tuple[int, int], kind: str, key: str) -> Column:
    """A permutation of 0 .. sides[0] * sides[1] - 1."""
    p, q = sides

    def step(r: Column, other: Column) -> Column:
        return _number(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), other.cast("string")), 256), 1, 14))

    start = F.struct(F.floor(x / q).cast("bigint").alias("a"), F.pmod(x, F.lit(q)).cast("bigint").alias("b"))
    done = F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        start,
        lambda st, r: F.struct(
            F.when(r % 2 == 0, F.pmod(st["a"] + step(r, st["b"]), F.lit(p))).otherwise(st["a"]).alias("a"),
            F.when(r % 2 == 1, F.pmod(st["b"] + step(r, st["a"]), F.lit(q))).otherwise(st["b"]).alias("b"),
        ),
    )
    return _let(done, lambda st: st["a"] * q + st["b"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _refill(v: Column, fresh: Column, slot: str) -> Column:
    """v with its characters of the class ``slot`` replaced by those of the array fresh, in order."""
    before = F.regexp_extract_all(v, F.lit(f"([^{slot}]*+)[{slot}]"), F.lit(1))
    return F.concat(F.array_join(F.zip_with(before, fresh, lambda gap, c: F.concat(gap, c)), ""), F.regexp_extract(v, f"(?:^|(?<=[{slot}]))([^{slot}]*+)$", 1))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, doubled(_at(digits, i).cast("int"))).otherwise(_at(digits, i).cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10


def _fresh_card(d: Column, key: str) -> Column:
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    new = feistel(body, F.repeat(F.lit("d"), F.length(body)), "card", key)
    return _let(F.array_join(new, ""), lambda b: F.concat(b, F.pmod(10 - luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))


def _cards(v: Column, key: str) -> Column:
    """(new, n): a run of groups of digits with its n cards replaced.  From each group on, the longest 13 to 19 digits that end
    with a group and pass their check are a card.  Where that isn't the whole run, the groups are as cards have them: the first of
    4, 6, 8 or at least 13 digits and none of less than 4 but the last, so that lists of other numbers are left."""

    def span(groups: Column, i: Column, j: Column) -> Column:
        return F.array_join(F.slice(groups, i, j - i + 1), "")

    def fits(groups: Column, i: Column, j: Column) -> Column:
        def passes(part: Column) -> Column:
            shaped = part.rlike("^[ -]?(?:[0-9]{4}|[0-9]{6}|[0-9]{8}|[0-9]{13,19})(?![0-9])(?:[ -][0-9]{4,})*(?:[ -][0-9]+)?$")
            whole = (i == 1) & (j == F.size(groups))
            return (whole | shaped) & _let(_digits(part), lambda d: F.length(d).between(13, 19) & (luhn(d) == 0))

        return _let(span(groups, i, j), passes)

    def take(groups: Column, state: Column, i: Column) -> Column:
        def card(j: Column) -> Column:
            new = _let(span(groups, i, j), lambda x: _let(_fresh_card(_digits(x), key), lambda f: _refill(x, _chars(f), "0-9")))
            return F.struct(F.concat(state["parts"], F.array(span(groups, state["done"] + 1, i - 1), new)).alias("parts"), j.alias("done"), (state["n"] + 1).alias("n"))

        ends = F.filter(F.sequence(i, F.least(F.size(groups), i + 18)), lambda j: fits(groups, i, j))
        return F.when(i <= state["done"], state).otherwise(_let(F.array_max(ends), lambda j: F.when(j.isNull(), state).otherwise(card(j))))

    def fold(groups: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("done"), F.lit(0).alias("n"))
        done = F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, lambda st, i: take(groups, st, i))
        return _let(done, lambda st: F.struct(F.concat(F.array_join(st["parts"], ""), span(groups, st["done"] + 1, F.size(groups))).alias("new"), st["n"].alias("n")))

    # each group but the first begins with its separator
    return _let(F.regexp_extract_all(v, F.lit("[ -]?[0-9]+"), F.lit(0)), fold)


def _mod97(s: Column) -> Column:
    """An account number's letters as two digits each, modulo 97; check digits moved to the end."""
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55))
    return F.aggregate(F.filter(values, lambda x: x.isNotNull()), F.lit(0).cast("bigint"), lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97)


def _mask(s: Column) -> Column:
    return F.translate(s, "0123456789" + _ALPHABETS["l"] + _ALPHABETS["u"], "d" * 10 + "l" * 26 + "u" * 26)


def _account(v: Column, key: str) -> Column:
    def fresh(s: Column) -> Column:
        body = F.substring(s, F.lit(5), F.length(s))
        new = feistel(body, _mask(body), "account", key)
        return _let(F.array_join(new, ""), lambda b: _let(F.concat(F.substring(s, 1, 2), F.lit("00"), b), lambda z: F.concat(F.substring(s, 1, 2), F.lpad((98 - _mod97(z)).cast("string"), 2, "0"), b)))

    def whole(x: Column) -> Column:
        return _let(F.regexp_replace(x, " ", ""), lambda s: F.when((F.length(s) >= 15) & (_mod97(s) == 1), _let(fresh(s), lambda f: _refill(x, _chars(f), "A-Z0-9"))))

    # the whole match, or else the longest part of whole groups from its start that passes
    def longest(groups: Column) -> Column:
        tries = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.concat(whole(F.array_join(F.slice(groups, F.lit(1), n), "")), F.array_join(F.slice(groups, n + 1, F.size(groups)), "")))
        return F.try_element_at(F.filter(tries, lambda t: t.isNotNull()), F.lit(1))

    return _let(F.regexp_extract_all(v, F.lit(" ?[A-Z0-9]+"), F.lit(0)), longest)


def _address(v: Column, key: str) -> Column:
    parts = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    packed = F.array_join(F.transform(parts, lambda x: F.lower(F.lpad(F.hex(x.cast("bigint")), 2, "0"))), "")
    fresh = _let(F.array_join(feistel(packed, F.lit("h" * 8), "address", key), ""), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _number(F.substring(h, i * 2 + 1, F.lit(2))).cast("string")), "."))
    return F.when(F.forall(parts, lambda x: x <= 255), fresh)


def _date(v: Column, key: str) -> Column:
    first = F.lit("1900-01-01").cast("date")

    def part(at: int, n: int) -> Column:
        return F.substring(v, at, n)

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.datediff(F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd"), first)

    def written(x: Column, order: str, joiner: str) -> Column:
        iso = F.date_format(F.date_add(first, x.cast("int")), "yyyy-MM-dd")
        pieces = {"y": F.substring(iso, 1, 4), "m": F.substring(iso, 6, 2), "d": F.substring(iso, 9, 2)}
        return F.concat_ws(joiner, *(pieces[k] for k in order))

    def moved(x: Column, order: str, joiner: str) -> Column:
        span = _DAY_SIDES[0] * _DAY_SIDES[1]
        return _let(x, lambda n: F.when((n >= 0) & (n < span), _let(feistel_number(n, _DAY_SIDES, "date", key), lambda y: written(y, order, joiner))))

    def late_before(month: Column) -> Column:
        """Days from a month's 13th on that come before a month counted from the first one."""
        return F.datediff(F.add_months(first, month.cast("int")), first) - 12 * month

    def late() -> Column:
        """Month first: such dates have a day from 13 on and are permuted among these, by their rank."""
        month = (part(7, 4).cast("int") - 1900) * 12 + part(1, 2).cast("int") - 1
        rank = F.when(day(part(7, 4), part(1, 2), part(4, 2)).isNotNull() & (month >= 0), late_before(month) + part(4, 2).cast("int") - 13)

        def back(r: Column) -> Column:
            near = F.floor(r / 18.436875).cast("int")  # days from the 13th on in a mean month
            held = F.filter(F.sequence(F.greatest(near - 2, F.lit(0)), near + 2), lambda m: late_before(m) <= r)
            return _let(F.array_max(held), lambda m: written(F.datediff(F.add_months(first, m), first) + 12 + r - late_before(m), "mdy", "/"))

        return _let(rank, lambda r: F.when(r < _LATE_SIDES[0] * _LATE_SIDES[1], _let(feistel_number(r, _LATE_SIDES, "late", key), back)))

    return (
        F.when(v.contains("-"), moved(day(part(1, 4), part(6, 2), part(9, 2)), "ymd", "-"))
        .when(v.contains("."), moved(day(part(7, 4), part(4, 2), part(1, 2)), "dmy", "."))
        .when(part(4, 2).cast("int") > 12, late())
        .otherwise(moved(day(part(7, 4), part(4, 2), part(1, 2)), "dmy", "/"))
    )


def _person(v: Column, key: str) -> Column:
    area, group, serial = F.substring(v, 1, 3).cast("bigint"), F.substring(v, 5, 2).cast("bigint"), F.substring(v, 8, 4).cast("bigint")
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    x = (rank * 99 + group - 1) * 9999 + serial - 1

    def back(y: Column) -> Column:
        r = F.floor(y / (99 * 9999)).cast("bigint")
        a = r + 1 + F.when(r >= 665, 1).otherwise(0)
        g, s = F.pmod(F.floor(y / 9999), F.lit(99)) + 1, F.pmod(y, F.lit(9999)) + 1
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad(g.cast("string"), 2, "0"), F.lpad(s.cast("string"), 4, "0"))

    return F.when(ok, _let(feistel_number(x, (898 * 99, 9999), "person", key), back))


def _phone(v: Column, key: str) -> Column:
    def code(d: Column) -> Column:
        known = {n: F.substring(d, F.lit(1), F.lit(n)).isin(codes.split()) for n, codes in _CODES.items()}
        return F.when(~v.startswith("+"), 0).when(known[1], 1).when(known[2], 2).otherwise(3)

    def fresh(d: Column, kept: Column) -> Column:
        def made(body: Column) -> Column:
            american = _at(body, F.lit(1)).rlike("[2-9]") & _at(body, F.lit(4)).rlike("[2-9]")
            # ten digits that aren't an American number keep the two that tell
            mask = F.when(F.length(body) != 10, F.repeat(F.lit("d"), F.length(body))).when(american, F.lit("nddndddddd")).otherwise(F.lit("kddkdddddd"))
            return F.concat(_chars(F.substring(d, F.lit(1), kept)), feistel(body, mask, "phone", key))

        return _let(F.substring(d, kept + 1, F.length(d)), made)

    return _let(_digits(v), lambda d: F.when(F.length(d).between(8, 15), _let(code(d), lambda c: _let(fresh(d, c), lambda f: _refill(v, f, "0-9")))))


def _email(v: Column, key: str) -> Column:
    name, rest = F.substring_index(v, "@", 1), F.substring(v, F.locate("@", v), F.length(v))
    made = lambda body: feistel(body, _mask(body), "email", key)
    return _let(_let(F.regexp_replace(name, "[^A-Za-z0-9]", ""), made), lambda f: F.concat(_let(name, lambda n: _refill(n, f, "A-Za-z0-9")), rest))


def _secret(v: Column, key: str) -> Column:
    head = F.when(v.startswith("AKIA"), F.lit("AKIA")).otherwise(F.regexp_extract(v, r"^[A-Za-z_]+[ \t]*[=:][ \t]*[\"']?", 0))
    made = lambda body: feistel(body, _mask(body), "secret", key)
    fresh = lambda tail: _let(_let(F.regexp_replace(tail, "[^A-Za-z0-9]", ""), made), lambda f: _refill(tail, f, "A-Za-z0-9"))
    return _let(head, lambda h: F.concat(h, _let(F.substring(v, F.length(h) + 1, F.length(v)), fresh)))


_MAKE = {"email": _email, "secret": _secret, "account": _account, "address": _address, "date": _date, "person": _person, "phone": _phone}


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """docs with ``text`` rewritten and a count n_<kind> of the values replaced of each kind."""
    look = F.coalesce(F.col(text).rlike(_WORTH_A_LOOK), F.lit(False))
    found = F.when(look, F.regexp_extract_all(F.col(text), F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def renewed(v: Column) -> Column:
        kind = reduce(lambda e, k: e.when(v.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)), _MAKE, F.when(F.lit(False), F.lit("")))
        return _let(kind, lambda k: _let(reduce(lambda e, x: e.when(k == x, _MAKE[x](v, key)), _MAKE, F.when(F.lit(False), F.lit(""))), lambda new: F.struct(F.when(new.isNotNull(), k).alias("kind"), F.coalesce(new, v).alias("new"))))

    def weave(gaps: Column, values: Column) -> Column:
        return F.array_join(F.flatten(F.zip_with(gaps, values, lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")

    def carded(gap: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(gap, F.lit(PATTERNS["card"]), F.lit(0)), lambda v: _cards(v, key))
        with_cards = _let(runs, lambda r: F.struct(weave(F.split(gap, PATTERNS["card"], -1), F.transform(r, lambda x: x["new"])).alias("new"), F.aggregate(r, F.lit(0), lambda n, x: n + x["n"]).alias("n")))
        return F.when(gap.rlike(PATTERNS["card"]), with_cards).otherwise(F.struct(gap.alias("new"), F.lit(0).alias("n")))

    c_found, c_new, c_gaps = unused(docs, "__found", "__new", "__gaps")
    rows = docs.drop(*COUNTS).withColumn(c_found, found)
    rows = rows.withColumn(c_new, F.when(look, F.transform(c_found, renewed)))
    rows = rows.withColumn(c_gaps, F.when(look, F.transform(F.split(F.col(text), _ANY, -1), carded)))
    woven = weave(F.transform(c_gaps, lambda g: g["new"]), F.transform(c_new, lambda x: x["new"]))

    def count(kind: str) -> Column:
        if kind == "card":
            n = F.aggregate(c_gaps, F.lit(0), lambda a, g: a + g["n"])
        else:
            n = F.size(F.filter(c_new, lambda x: x["kind"] == kind))
        return F.when(F.col(c_new).isNull(), 0).otherwise(n).cast("bigint")

    rows = rows.withColumns({c: count(c[2:]) for c in COUNTS})
    return rows.withColumn(text, F.when(F.col(c_new).isNull(), F.col(text)).otherwise(woven)).drop(c_found, c_new, c_gaps)
