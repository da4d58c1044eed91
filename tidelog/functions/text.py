"""Column building blocks: numbers in text, regular expressions, hashes, buckets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def to_number(c: Column, dtype: str) -> Column:
    """The value as a double, null where the text isn't a number."""
    if dtype in NUMERIC_TYPES or dtype.startswith("decimal"):
        return c.cast("double")
    c = c.cast("string")
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def number_text(c: Column) -> Column:
    """A double's shortest digits: plain from 1e-4 to below 1e6, with an exponent of two digits or more otherwise."""
    s = c.cast("string")
    part = lambda k: F.regexp_extract(s, r"^-?([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", k)
    whole = F.concat(part(1), part(2))
    lead = F.length(F.regexp_extract(whole, "^0*", 0))
    digits = F.regexp_replace(F.regexp_replace(whole, "^0+", ""), "0+$", "")
    point = F.length(part(1)) + F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0)) - lead
    size, exponent = F.length(digits), point - 1
    power = F.abs(exponent).cast("string")
    scientific = F.concat(
        F.substring(digits, 1, 1), F.when(size > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(F.lit("")),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power),
    )
    plain = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)).when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
    plain = plain.otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
    text = F.when(digits == "", F.lit("0")).when((exponent < -4) | (exponent >= 6), scientific).otherwise(plain)
    sign = F.when(s.startswith("-") & (digits != ""), F.lit("-")).otherwise(F.lit(""))
    return F.when(s.isin("NaN"), s).when(s == "Infinity", F.lit("+Inf")).when(s == "-Infinity", F.lit("-Inf")).otherwise(F.concat(sign, text))


def epoch_micros(c: Column, dtype: str) -> Column:
    """Microseconds since 1970 of a timestamp or, without any zone, of a date and time."""
    if dtype == "timestamp":
        return F.unix_micros(c)
    if dtype == "timestamp_ntz":
        seconds = F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000


def whole_units(c: Column, unit: int) -> Column:
    """How often the unit goes into a whole number, rounded down; nanoseconds are too long for a division in doubles."""
    return F.round((c - F.pmod(c, F.lit(unit))) / F.lit(unit)).cast("bigint")


def utc(seconds: Column) -> Column:
    """A timestamp that the session's zone shows as UTC."""
    return F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())


#: Names of character sets that a bracket may hold: fixed values of POSIX.
POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}


def valid_regexp(pattern: str) -> bool:
    """Whether the JVM takes the pattern."""
    from py4j.protocol import Py4JError
    from pyspark.errors import IllegalArgumentException
    from pyspark.sql import SparkSession

    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(java_regexp(pattern)[0])
    except (Py4JError, IllegalArgumentException):
        return False
    return True


def java_replacement(pattern: str, new: str) -> str:
    """``$1``, ``${1}``, ``$name`` and ``${name}`` as group numbers; of another dollar sign, itself; an unknown group is empty."""
    _, names = java_regexp(pattern)
    groups = len(re.findall(r"(?<!\\)\((?!\?)|\(\?P?<\w+>", pattern))

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        if m[0] in ("$", "\\"):
            return "\\" + m[0]
        name = m[1] or m[2]
        number = int(name) if name.isdigit() else names.get(name, -1)
        return f"${{{number}}}" if 0 <= number <= groups else ""

    made = re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)|\$|\\", one, new)
    return re.sub(r"\$\{(\d+)\}(?=(\d)?)", lambda m: f"${m[1]}" + ("\\" if m[2] else ""), made)


def java_regexp(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern in Java's dialect, and the numbers of its named groups."""
    out, names, groups, at, inside = [], {}, 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("\\Q", at) and not inside:
            stop = pattern.find("\\E", at)
            stop = stop if stop >= 0 else len(pattern)
            out.append(re.escape(pattern[at + 2 : stop]))
            at = stop + 2
            continue
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if inside:
            m = re.match(r"\[:(\^?)(\w+):\]", pattern[at:])
            if m and m[2] in POSIX:
                own = POSIX[m[2]]
                out.append(own.replace(own[1], own[1].upper(), 1) if m[1] else own)
                at += m.end()
                continue
            # a bracket or && inside a set is plain text, and so is a closing bracket that comes first
            if c == "[" or pattern.startswith("&&", at) or c == "]" and pattern[at - 1 : at] in ("[",) or c == "]" and pattern[at - 2 : at] == "[^":
                c = "\\" + c
            else:
                inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            m = re.match(r"\(\?P?<(\w+)>", pattern[at:])
            if m or pattern[at + 1 : at + 2] != "?":
                groups += 1
            if m:
                names[m[1]] = groups
                at += m.end()
                out.append("(")
                continue
        elif c == "$":
            c = r"\z"
        out.append(c)
        at += 1
    return "(?d)" + "".join(out), names


def fnv1a64(c: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as lower-case hex; the 64-bit product is taken in two 32-bit halves."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    size = F.octet_length(c)
    data = F.hex(F.encode(c, "UTF-8"))
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("h"), F.lit(0x84222325).cast("bigint").alias("l"))

    def step(s, k):
        low = s["l"].bitwiseXOR(F.conv(F.substring(data, k * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
        # the prime is 2^40 + 435
        product = low * F.lit(435)
        high = s["h"] * F.lit(435) + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(mask).alias("h"), product.bitwiseAND(mask).alias("l"))

    def text(s):
        both = F.lower(F.concat(F.hex(s["h"]), F.lpad(F.hex(s["l"]), 8, "0")))
        return F.coalesce(F.nullif(F.regexp_replace(both, "^0+", ""), F.lit("")), F.lit("0"))

    return F.when(size == 0, F.lit("cbf29ce484222325")).otherwise(F.aggregate(F.sequence(F.lit(0), size - 1), start, step, text))


def log_bucket(v: Column) -> Column:
    """Number of a value's histogram bucket: 18 for each decade from 1e-9 to 1e18, upper bound included."""
    f = (F.log10(v) + 9) * 18
    return F.least(F.lit(485), F.greatest(F.lit(0), F.when(f == F.floor(f), F.floor(f) - 1).otherwise(F.floor(f)))).cast("bigint")


def stream_label(fields: tuple[str, ...], text) -> Column:
    """``{a="x",b="y"}`` of the non-empty fields, by name."""
    parts = [F.when(text(f) != "", F.concat(F.lit(f'{f}="'), text(f), F.lit('"'))) for f in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("{}")
