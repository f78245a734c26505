"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame and SQL functions only.

E-mail names, card and account numbers, phone and social-security numbers, IPv4 addresses and dates are
found by one pattern, validated by kind, and replaced by a keyed permutation of the values of the same format:
digits stay digits, letters keep their case, punctuation, country codes, domains and lengths stay, and check
digits are made anew. What is permuted is the value without its punctuation, blanks and case, which are put back, so
equal values get equal pseudonyms in all documents however they are written, and different values different ones: valid numbers are
permuted among the valid ones, and the others among the others. The permutation depends on the key and the kind only. The key reaches the plan as "bw8:" and its SHA-256, which stands for it: set
spark.sql.redaction.string.regex to bw8:[0-9a-f]{64} to keep it out of plans and event logs.

A string is split in halves; in each of ROUNDS rounds one half is shifted, character by character within its
class, by a hash of key, kind, round and the other half. Addresses (2 x 16 bits) and dates (2 x 8 bits within a
span of 65536 days) go through the same network on numbers. What looks like a date or an address but isn't a valid
one is left; a long number that fails its check is permuted without one.

Edge cases: a null text stays null with no finds; an empty text has none; repeated rows get the same pseudonyms; extra
columns are kept, but one with the count's name is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
ADDRESS = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?![\d/])|(?<![\d.])\d{1,2}\.\d{1,2}\.\d{4}(?!\.?\d)"
NUMBER = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"
# Telephone country codes of one and two digits; all others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
PATTERN = "|".join((EMAIL, IBAN, ADDRESS, PHONE, SOCIAL, DATE, NUMBER))


def _quoted(s: str) -> str:
    return "r'" + s + "'"


def _hash(key: str, kind: str, half: str) -> str:
    return f"sha2(concat('{key}|{kind}|', n, '|', {half}), 256)"


def permuted(s: str, kind: str, key: str) -> str:
    """SQL of the permutation of a string among the strings with the same classes of characters."""
    byte = "CAST(conv(substring(h, 2 * (i % 32) + 1, 2), 16, 10) AS INT)"
    turn = lambda low, high, size: f"WHEN c BETWEEN '{low}' AND '{high}' THEN char({ord(low)} + (ascii(c) - {ord(low)} + {byte}) % {size})"
    shift = f"CASE {turn('0', '9', 10)} {turn('a', 'z', 26)} {turn('A', 'Z', 26)} ELSE c END"
    other = f"element_at(transform(array({_hash(key, kind, 'a.r')}), h -> array_join(transform(split(a.l, ''), (c, i) -> {shift}), '')), 1)"
    start = f"named_struct('l', substring({s}, 1, length({s}) div 2), 'r', substring({s}, length({s}) div 2 + 1, length({s})))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (a, n) -> named_struct('l', a.r, 'r', {other}), a -> concat(a.l, a.r))"


def permuted_number(x: str, bits: int, kind: str, key: str) -> str:
    """SQL of the permutation of the numbers of 2 * bits bits."""
    digits, size = bits // 4, 1 << bits
    start = f"named_struct('l', CAST({x} div {size} AS BIGINT), 'r', CAST({x} % {size} AS BIGINT))"
    other = f"a.l ^ CAST(conv(substring({_hash(key, kind, 'a.r')}, 1, {digits}), 16, 10) AS BIGINT)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (a, n) -> named_struct('l', a.r, 'r', {other}), a -> a.l * {size} + a.r)"


def _bound(value: str, name: str, body: str) -> str:
    """SQL of body with name standing for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _refit(value: str, kept: str = "0-9") -> str:
    """SQL that puts the characters of a value back at the places in m that hold such characters."""
    step = f"IF(c RLIKE '[{kept}]', named_struct('s', concat(a.s, substring(v, a.i, 1)), 'i', a.i + 1), named_struct('s', concat(a.s, c), 'i', a.i))"
    return _bound(value, "v", f"aggregate(split(m, ''), named_struct('s', '', 'i', 1), (a, c) -> {step}, a -> a.s)")


def _digits(body: str) -> str:
    """SQL of body, in which d stands for the digits of m, put back into m."""
    return _refit(_bound("regexp_replace(m, '[^0-9]', '')", "d", body))


def _walked(s: str, kind: str, key: str, good: Callable[[str], str], most: int) -> str:
    """SQL that walks the permutation's cycle until a good value comes, so good values are permuted among themselves.

    Each step is good with the share that good ones have of all; after `most` steps the value itself is
    taken, which is good: a chance of 1 in 10 ** 35 or less, so the walk's end isn't met in practice.
    """
    step = f"IF(a.k > 0 AND {good('a.s')}, a, named_struct('s', {permuted('a.s', kind, key)}, 'k', a.k + 1))"
    return f"aggregate(sequence(1, {most}), named_struct('s', {s}, 'k', 0), (a, w) -> {step}, a -> IF({good('a.s')}, a.s, {s}))"


def _card(key: str) -> str:
    plain = "concat(b, CAST(element_at(filter(sequence(0, 9), k -> luhn_check(concat(b, k))), 1) AS STRING))"
    checked = _bound(permuted("substring(d, 1, length(d) - 1)", "card", key), "b", plain)
    return _digits(f"IF(luhn_check(d), {checked}, {_walked('d', 'number', key, lambda s: f'NOT luhn_check({s})', 40)})")


def _remainder(s: str) -> str:
    numbers = f"array_join(transform(split({s}, ''), c -> IF(c BETWEEN 'A' AND 'Z', CAST(ascii(c) - 55 AS STRING), c)), '')"
    return f"aggregate(split({numbers}, ''), 0, (r, c) -> (r * 10 + CAST(c AS INT)) % 97)"


def _iban(key: str) -> str:
    rest, country = "substring(x, 5, length(x))", "substring(x, 1, 2)"
    check = lambda s: f"lpad(CAST(98 - {_remainder(f'concat({s}, {country}, {chr(39)}00{chr(39)})')} AS STRING), 2, '0')"
    valid = f"{_remainder('concat(' + rest + ', substring(x, 1, 4))')} = 1"
    # wrong check digits stay, unless they are right for the new number: then they become those that the old one should have
    wrong = f"IF(substring(x, 3, 2) = k, {check(rest)}, substring(x, 3, 2))"
    made = _bound(permuted(rest, "iban", key), "b", _bound(check("b"), "k", f"concat({country}, IF({valid}, k, {wrong}), b)"))
    return _refit(_bound("replace(m, ' ', '')", "x", made), "A-Z0-9")


def _social(key: str) -> str:
    valid = lambda s: f"NOT {s} RLIKE r'^(000|666|9)|^...00|0000$'"
    # one number in nine isn't valid
    return _digits(f"IF({valid('d')}, {_walked('d', 'social', key, valid, 48)}, {_walked('d', 'social', key, lambda s: f'NOT ({valid(s)})', 700)})")


def _phone(key: str) -> str:
    code = f"IF(m LIKE '+%', regexp_extract(d, {_quoted(COUNTRY)}, 0), '')"
    return _digits(_bound(code, "o", f"concat(o, {permuted('substring(d, length(o) + 1, length(d))', 'phone', key)})"))


def _mail(key: str) -> str:
    name = "substring_index(m, '@', 1)"
    cased = f"array_join(transform(split({name}, ''), (c, i) -> IF(c BETWEEN 'A' AND 'Z', upper(substring(v, i + 1, 1)), substring(v, i + 1, 1))), '')"
    return f"concat({_bound(permuted(f'lower({name})', 'mail', key), 'v', cased)}, '@', substring_index(m, '@', -1))"


def _address(key: str) -> str:
    number = "aggregate(split(m, r'\\.'), 0L, (t, o) -> t * 256 + CAST(o AS BIGINT))"
    octets = "concat_ws('.', CAST(x div 16777216 AS STRING), CAST(x div 65536 % 256 AS STRING), CAST(x div 256 % 256 AS STRING), CAST(x % 256 AS STRING))"
    return _bound(permuted_number(number, 16, "address", key), "x", octets)


def _date(key: str) -> str:
    def moved(day: str, form: str) -> str:
        number = _bound(f"datediff({day}, DATE'1970-01-01')", "d", f"CAST(floor(d / 65536) * 65536 + {permuted_number('pmod(d, 65536)', 8, 'date', key)} AS INT)")
        return f"date_format(date_add(DATE'1970-01-01', {number}), '{form}')"

    def parsed(forms: list[str], out: str) -> str:
        tries = ", ".join(f"to_date(try_to_timestamp(m, '{f}'))" for f in forms)
        return _bound(f"coalesce({tries})", "y", f"IF(y IS NULL, m, {moved('y', out)})")

    slash = f"IF(to_date(try_to_timestamp(m, 'd/M/yyyy')) IS NULL, {parsed(['M/d/yyyy'], 'MM/dd/yyyy')}, {parsed(['d/M/yyyy'], 'dd/MM/yyyy')})"
    return f"CASE WHEN m LIKE '%-%' THEN {parsed(['yyyy-MM-dd'], 'yyyy-MM-dd')} WHEN m LIKE '%/%' THEN {slash} ELSE {parsed(['d.M.yyyy'], 'dd.MM.yyyy')} END"


def pseudonym(key: str) -> str:
    """SQL of the pseudonym of a match m of PATTERN."""
    return f"""CASE WHEN m LIKE '%@%' THEN {_mail(key)}
        WHEN m RLIKE '^[A-Z]' THEN {_iban(key)}
        WHEN m RLIKE {_quoted('^' + OCTET + '([.]' + OCTET + '){3}$')} THEN {_address(key)}
        WHEN m RLIKE r'^[+(]|^\\d{{3}}[.-]\\d{{3}}[.-]\\d{{4}}$' THEN {_phone(key)}
        WHEN m RLIKE r'^\\d{{3}}-\\d{{2}}-\\d{{4}}$' THEN {_social(key)}
        WHEN length(m) <= 10 THEN {_date(key)}
        ELSE {_card(key)} END"""


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str = "n_found") -> DataFrame:
    """docs with every find in `text` replaced, and `count`, the number of finds. The key is any secret string."""
    secret = "bw8:" + hashlib.sha256(key.encode()).hexdigest()
    held = "_found" + "_" * max(map(len, docs.columns))  # no column has this name
    # whatever matches holds a digit or an at sign; most texts are settled by that cheaper look
    matches = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    found = docs.withColumn(held, F.when(F.col(text).rlike("[0-9@]"), matches).otherwise(F.array().cast("array<string>")))
    made = F.expr(f"transform({held}, m -> {pseudonym(secret)})")
    between = F.split(F.col(text), PATTERN, -1)
    whole = F.array_join(F.transform(F.arrays_zip(between.alias("p"), made.alias("q")), lambda x: F.concat(x["p"], F.coalesce(x["q"], F.lit("")))), "")
    new = F.when(F.size(held) > 0, whole).otherwise(F.col(text))
    return found.withColumns({text: new, count: F.coalesce(F.when(F.col(held).isNotNull(), F.size(held)), F.lit(0)).cast("long")}).drop(held)
