"""PII (10): format-preserving pseudonyms by keyed Feistel permutations, in SQL functions only.

Numbers and dates are validated first (Luhn, mod 97, octets, calendar, number areas); what doesn't validate stays. A
value is a pair (a, b) of a product domain; each round adds a keyed hash of one half to the other, modulo its size. That
is a bijection of the domain for any sizes, so a value keeps its format and its validity, and equal values get equal
pseudonyms in every document. E-mail addresses and secrets have no numeric domain: they get keyed hashes in their format.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import once

ROUNDS = 8
_EDGE_L, _EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_HEX = "[0-9A-Fa-f]"
#: Words before a secret, and before digests that are none.
_KEYWORD = r"(?i:token|secret|password|passwd|passphrase|pwd|credential|bearer|(?:api|access|private|auth)[_\-]?key)"
#: What keys of common services begin with, and how they go on.
_KNOWN_KEYS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}"
_KNOWN_START = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[rs]k_(?:live|test)_|AIza)"
_DIGEST = r"(?i:commit|revision|changeset|tree|parent|sha-?1|sha-?256|sha-?512|md5|digest|checksum|hash|etag)"
#: Bare hex of 32 digits or more is a secret, but for 40 digits (names of commits) and what a digest's name precedes; after
#: a keyword any quoted value of 8 signs is one, and an unquoted one that has a digit.
_SECRET = (
    # cheap looks at the next and the last sign come first
    rf"(?<![\p{{L}}\p{{N}}_])(?=[Agxrs])(?:{_KNOWN_KEYS})(?![\p{{L}}\p{{N}}_])"
    rf"|(?={_HEX}{{32}})(?<![\p{{L}}\p{{N}}_])(?!{_HEX}{{40}}(?!{_HEX}))(?<!{_DIGEST}[\"']? {{0,2}}[:=]? {{0,2}}[\"']?){_HEX}{{32,}}+(?![\p{{L}}\p{{N}}_@])"
    rf"|(?<=[\"'])(?=[^\"'\s]{{8}})(?<={_KEYWORD}[\"']? ?[=:] ?[\"'])[^\"'\s]{{8,}}+(?=[\"'])"
    rf"|(?<=[=: ])(?=[^\"'\s,;0-9]*+[0-9])(?<=[=:] ?)(?<={_KEYWORD}[\"']? ?[=:] ?)[^\"'\s,;]{{7,}}[^\"'\s,;.!?)]"
)
_PLUS = r"(?<![\p{L}\p{N}_+])"
_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
#: kind -> pattern; the order decides where two could begin at one place.
PATTERNS = {
    "email": _EDGE_L + r"[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*(?<=\.[A-Za-z]{2,63})",
    "iban": _EDGE_L + f"(?:{_IBAN}|{_IBAN.replace('A-Z', 'a-z')})" + _EDGE_R,
    "phone": "|".join([_PLUS + r"\+[0-9]{1,3}[ .\-][0-9]{1,5}[ .\-/][0-9]{5,8}" + _EDGE_R, _PLUS + r"(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,5}\)[ .\-]?(?:[0-9]{3,4}[ .\-][0-9]{3,4}|[0-9]{5,8})" + _EDGE_R, _PLUS + r"\+[0-9]{1,3}(?:[ .\-][0-9]{2,4}){2,4}" + _EDGE_R,
        _PLUS + r"\+[1-9][0-9]{7,14}" + _EDGE_R, r"(?<![\p{L}\p{N}_.+\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![\p{L}\p{N}_\-])", r"(?<![\p{L}\p{N}_.,+/\-])0[1-9][0-9]{1,3}[ /\-][0-9]{5,8}(?![\p{L}\p{N}_\-])",
        r"(?<=[ .:#])(?<=\b(?i:phone|tel|telephone|call|mobile|cell|fax|whatsapp)(?: (?:me|us))?(?: (?:no|number|at|on))?(?: is)?[.:#]? ?)[0-9]{9,11}(?![\p{L}\p{N}_\-]|[.,][0-9])"]),
    "ip": r"(?<![\p{L}\p{N}_.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}_]|\.[0-9])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}_:.])(?:(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}|(?=[0-9A-Fa-f:]*[0-9])(?:{_HEX}{{1,4}}:){{1,5}}(?::{_HEX}{{1,4}}){{1,5}})(?![\p{{L}}\p{{N}}_:])",
    "date": r"(?<![\p{L}\p{N}_/.\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\p{L}\p{N}_/\-]|\.[0-9])",
    "ssn": r"(?<![\p{L}\p{N}_.\-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|(?<![0-9] )[0-9]{3} [0-9]{2} [0-9]{4}(?! [0-9]))(?![\p{L}\p{N}_\-])",
    "card": r"(?<![\p{L}\p{N}_.\-])[0-9](?:[ \-]?[0-9]){12,18}(?![\p{L}\p{N}_\-])",
}
ANY = "|".join([f"({_SECRET})", *PATTERNS.values()])
#: What any text with one of these has; a cheap test before the patterns.
HINT = "[0-9@]|[=:] ?[\"']|A[KS]IA|xox|AIza|gh[pousr]_|github_pat_|glpat-|k_(?:live|test)_"


def _key(key: str | Column) -> Column:
    return F.lit(key) if isinstance(key, str) else key


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _hash(key: str | Column, *parts: Column) -> Column:
    """A number below 2**52 that depends on the key and all parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", _key(key), *[p.cast("string") for p in parts]), 256), 1, 13), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str | Column, kind: str) -> Column:
    """struct(a, b): the permutation of pairs with 0 <= a < size_a and 0 <= b < size_b."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(x: Column, i: Column) -> Column:
        left = F.pmod(x["a"] + _hash(key, F.lit(kind), size_a, size_b, i, x["b"]), size_a)
        right = F.pmod(x["b"] + _hash(key, F.lit(kind), size_a, size_b, i, x["a"]), size_b)
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(x["a"]).alias("a"), F.when(even, x["b"]).otherwise(right).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(d: Column, key: str | Column, kind: str, base: int = 10) -> Column:
    """A digit string of 1 to 30 digits (base 16: 28) -> another of the same length, one to one."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(float(base)), k).cast("long")
    number = lambda s: F.coalesce(F.conv(s, base, 10).cast("long"), F.lit(0).cast("long"))
    put = lambda v, k: F.lpad(F.lower(F.conv(v.cast("string"), 10, base)), k, "0")
    pair = feistel(number(F.substr(d, F.lit(1), u)), number(F.substr(d, u + 1)), size(u), size(n - u), key, kind)
    return once(pair, lambda p: F.concat(F.when(u > 0, put(p["a"], u)).otherwise(F.lit("")), put(p["b"], n - u)))


def _into(form: Column, digits: Column, sign: str = "[0-9]") -> Column:
    """form with its digits (what `sign` matches) replaced, in order, by those of digits."""
    return once(digits, lambda d: _put(form, d, sign))


def _put(form: Column, digits: Column, sign: str) -> Column:
    count = lambda s: F.length(s) - F.length(F.regexp_replace(s, sign, ""))
    places = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.struct(F.substr(form, i, F.lit(1)).alias("c"), count(F.substr(form, F.lit(1), i)).alias("k")))
    return F.array_join(F.transform(places, lambda p: F.when(p["c"].rlike(sign), F.substr(digits, p["k"], F.lit(1))).otherwise(p["c"])), "")


def luhn_sum(d: Column, doubled_last: bool) -> Column:
    """Sum of the digits, every second one doubled from the right, beginning with the last or the one before."""
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when((i % 2 == 0) == F.lit(doubled_last), F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def mod97(s: Column) -> Column:
    """ISO 7064 rest of a string of digits and capitals (A = 10 ... Z = 35)."""
    value = F.transform(F.split(s, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda r, v: F.when(v < 10, r * 10 + v).otherwise(r * 100 + v) % 97)


def _card(x: Column, key: str | Column) -> Column:
    """Numbers that networks give out (from 22 to 69); the first two digits name the network and stay."""
    d = _digits(x)
    body = F.concat(F.substr(d, F.lit(1), F.lit(2)), permute_digits(F.substr(d, F.lit(3), F.length(d) - 3), key, "card"))
    checked = lambda b: F.concat(b, F.pmod(-luhn_sum(b, True), F.lit(10)).cast("string"))
    return F.when((luhn_sum(d, False) % 10 == 0) & d.rlike("^(?:2[2-7]|[3-6])"), _into(x, once(body, checked)))


def _iban(x: Column, key: str | Column) -> Column:
    """Country and bank letters stay, the digits are permuted and the check digits follow."""
    plain = F.upper(F.replace(x, F.lit(" "), F.lit("")))
    bban = F.substr(plain, F.lit(5))
    digits = _digits(bban)
    country = F.substr(plain, F.lit(1), F.lit(2))
    check = lambda b: F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
    other = once(_into(bban, permute_digits(digits, key, "iban")), lambda b: F.concat(check(b), _digits(b)))
    valid = mod97(F.concat(bban, F.substr(plain, F.lit(1), F.lit(4)))) == 1
    return F.when(valid & F.length(digits).between(2, 30), _into(x, other))


#: Country codes of one and of two digits; all others have three.
_LAND1, _LAND2 = "^[17]", "^(?:20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _phone(x: Column, key: str | Column) -> Column:
    """The country code stays; the other digits are permuted, however they are grouped."""

    def of(d: Column) -> Column:
        land = F.when(~F.startswith(x, F.lit("+")), 0).when(d.rlike(_LAND1), 1).when(d.rlike(_LAND2), 2).otherwise(3)
        rest = F.substr(d, land + 1)
        return F.when(F.length(rest).between(6, 15), _into(x, F.concat(F.substr(d, F.lit(1), land), permute_digits(rest, key, "phone"))))

    return once(_digits(x), of)


def _ip(x: Column, key: str | Column) -> Column:
    o = F.transform(F.split(x, r"\."), lambda c: c.cast("long"))
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    octets = lambda p: F.concat_ws(".", *[v.cast("string") for v in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)])
    return F.when(F.array_max(o) <= 255, once(out, octets))


def _ssn(x: Column, key: str | Column) -> Column:
    area, group, serial = (F.split(x, "[ -]")[i].cast("long") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = (area - 1 - (area > 666).cast("long")) * 99 + group - 1
    out = feistel(rank, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def form(p: Column) -> Column:
        low = F.floor(p["a"] / 99)
        parts = (low + 1 + (low >= 665).cast("long"), 3), (p["a"] % 99 + 1, 2), (p["b"] + 1, 4)
        return _into(x, F.concat(*[F.lpad(v.cast("string"), n, "0") for v, n in parts]))

    return F.when(valid, once(out, form))


def _ipv6(x: Column, key: str | Column) -> Column:
    """The first group names the network and stays; the other seven, written out, are permuted together. All forms of an address
    get one pseudonym, of eight groups."""
    sides = F.split(F.lower(x), "::")
    groups = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":"))
    left, right = groups(sides[0]), F.when(F.size(sides) > 1, groups(F.try_element_at(sides, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    given = F.size(left) + F.size(right)
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), right)
    full = F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), "")
    put = lambda d: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(d, 4 * i + 1, F.lit(4)), "^0{1,3}", "")), ":")
    other = once(full, lambda d: F.concat(F.substr(d, F.lit(1), F.lit(4)), permute_digits(F.substr(d, F.lit(5), F.lit(28)), key, "ipv6", 16)))
    return F.when(F.when(F.size(sides) > 1, given.between(3, 7)).otherwise(given == 8), once(other, put))


_START = "1800-01-01"
#: Factors of the number of days after the 12th of a month in the 400 years from _START, and of all others.
_LATE_DAYS, _EARLY_DAYS = (9, 9833), (240, 240)


def _permuted_day(day: Column, key: str | Column) -> Column:
    """Days after the 12th of a month among themselves, and all others too: a text that can only be read month first has another
    such day, whichever form it is written in."""
    start = F.to_date(F.lit(_START))
    month = (F.year(day) - 1800) * 12 + F.month(day) - 1
    late = F.dayofmonth(day) > 12
    rank = F.when(late, F.datediff(day, start) - 12 * month - 12).otherwise(12 * month + F.dayofmonth(day) - 1)
    size = lambda i: F.when(late, F.lit(_LATE_DAYS[i])).otherwise(F.lit(_EARLY_DAYS[i]))
    before = lambda m: F.datediff(F.add_months(start, m), start) - 12 * m  # noqa: E731  days after the 12th before month m

    def found(r: Column) -> Column:
        near = F.floor(r * 4800 / (_LATE_DAYS[0] * _LATE_DAYS[1])).cast("int")
        m = F.array_max(F.filter(F.sequence(F.greatest(near - 3, F.lit(0)), near + 3), lambda c: before(c) <= r))
        of_late = once(m, lambda c: F.date_add(F.add_months(start, c), (r - before(c) + 12).cast("int")))
        return F.when(late, of_late).otherwise(F.date_add(F.add_months(start, F.floor(r / 12).cast("int")), (r % 12).cast("int")))

    def of(n: Column) -> Column:
        out = feistel(F.floor(n / size(1)), n % size(1), size(0), size(1), key, "date")
        return once(once(out, lambda o: o["a"] * size(1) + o["b"]), found)

    return once(rank, of)


def _date(x: Column, key: str | Column) -> Column:
    """A day of the 400 years from 1800, by one permutation of all days whatever form it has, written as it was read.

    Texts are read day first, but for those like 12/31/1999 that can only be month first. All texts of one day stay linked, and
    each form's texts are mapped one to one."""
    year_first, mark = x.rlike("^[0-9]{4}"), F.regexp_extract(x, "[/.-]", 0)
    parts = F.split(x, "[/.-]")
    short = x.rlike(r"(?:^|[/.])[0-9](?:[/.]|$)")

    def of(n: Column) -> Column:
        month_first = ~year_first & (mark == "/") & (n[1] > 12) & (n[0] <= 12)
        year, month = F.when(year_first, n[0]).otherwise(n[2]), F.when(year_first, n[1]).when(month_first, n[0]).otherwise(n[1])
        day = F.when(year_first, n[2]).when(month_first, n[1]).otherwise(n[0])
        read = F.try_to_timestamp(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")

        def put(d: Column) -> Column:
            two = lambda v: F.when(short, v.cast("string")).otherwise(F.lpad(v.cast("string"), 2, "0"))
            m, dd, y = two(F.month(d)), two(F.dayofmonth(d)), F.year(d).cast("string")
            return F.when(year_first, F.concat(y, mark, m, mark, dd)).when(month_first, F.concat(m, mark, dd, mark, y)).otherwise(F.concat(dd, mark, m, mark, y))

        return once(read, lambda d: F.when(F.year(d).between(1800, 2199), once(_permuted_day(d, key), put)))

    return once(F.transform(parts, lambda p: p.cast("int")), of)


def _email(x: Column, key: str | Column) -> Column:
    local, domain = F.substring_index(x, "@", 1), F.lower(F.substring_index(x, "@", -1))
    h = lambda c, n: F.substring(F.sha2(F.concat(_key(key), F.lit(":email:"), c), 256), 1, n)
    return F.concat(F.lit("u"), h(F.concat_ws("@", local, domain), 12), F.lit("@d"), h(domain, 8), F.lit(".invalid"))


def _secret(x: Column, key: str | Column) -> Column:
    block = lambda i: F.sha2(F.concat(_key(key), F.lit(":secret:"), i.cast("string"), F.lit(":"), x), 512)
    start = F.regexp_extract(x, _KNOWN_START, 0)  # of a known service: it stays
    return F.concat(start, F.substr(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / 128).cast("int")), block), ""), F.lit(1), F.length(x) - F.length(start)))


_MAKE = {"email": _email, "iban": _iban, "phone": _phone, "ip": _ip, "ipv6": _ipv6, "date": _date, "ssn": _ssn, "card": _card}


def pseudonym(x: Column, secret: Column, key: str | Column) -> Column:
    """struct(kind, value) of a match of ANY; secret: the part of it that its first group matched.

    value is null where the value doesn't validate."""
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in reversed(PATTERNS):  # a match by itself has no neighbours; bare digits are a number after a word for it
        hit = x.rlike(f"^(?:{PATTERNS[k]}{'|[0-9]{9,11}' if k == 'phone' else ''})$")
        kind = F.when(hit, F.lit(k)).otherwise(kind)
        value = F.when(hit, _MAKE[k](x, key)).otherwise(value)
    kind, value = F.when(secret != "", F.lit("secret")).otherwise(kind), F.when(secret != "", _secret(x, key)).otherwise(value)
    return F.struct(kind.alias("kind"), value.alias("value"))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_private") -> DataFrame:
    """docs with private values of text_col replaced, and count_col: how many were.

    Everything between the values stays as it is, character by character. A null text stays null and counts 0. All rows
    and other columns stay, whatever their names; a column named count_col is replaced. The key is read from a table of
    one row and stands in no plan.
    """
    secret, found, between = (f"{n}_{uuid.uuid4().hex}" for n in ("key", "found", "between"))
    text, names = F.col(text_col), list(docs.columns)
    keys = docs.sparkSession.createDataFrame([(key,)], "k string")
    hits = lambda group: F.regexp_extract_all(text, F.lit(ANY), F.lit(group))
    out = docs.withColumn(secret, keys.scalar()).withColumn(found, F.when(text.rlike(HINT), hits(0)))
    pairs = F.when(F.size(found) > 0, F.zip_with(F.col(found), hits(1), lambda x, s: F.struct(x.alias("old"), pseudonym(x, s, F.col(secret)).alias("new"))))
    out = out.withColumn(found, pairs).withColumn(between, F.when(F.size(found) > 0, F.split(text, ANY, -1)))
    joined = F.concat(F.col(between)[0], F.array_join(F.transform(found, lambda x, i: F.concat(F.coalesce(x["new"]["value"], x["old"]), F.col(between)[i + 1])), ""))
    if count_col:
        counted = F.coalesce(F.size(F.filter(found, lambda x: x["new"]["value"].isNotNull())), F.lit(0))
        out = out.withColumn(count_col, F.greatest(counted, F.lit(0)).cast("int"))
        names += [count_col] * (count_col not in names)
    return out.withColumn(text_col, F.when(F.size(found) > 0, joined).otherwise(text)).select(*[F.col(f"`{c}`") for c in names])
