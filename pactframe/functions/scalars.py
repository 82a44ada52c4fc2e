"""Strict scalar conversions of text: null where the text is not exactly in the form."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The forms of scalars as text.
DAY = r"^\d{4}-\d{2}-\d{2}$"
INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$"
CLOCK = r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?$"
DURATION = r"^(-?)P(?:(\d+)D)?(T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,6}))?S)?)?$"
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def text_int(c: Column) -> Column:
    return F.when(c.rlike(r"^-?(0|[1-9][0-9]*)$"), c.try_cast("bigint"))


def text_float(c: Column) -> Column:
    value = c.try_cast("double")
    return F.when(c.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$") & (F.abs(value) < float("inf")), value)


def text_bool(c: Column) -> Column:
    return F.when(c == "true", True).when(c == "false", False)


def text_null(c: Column) -> Column:
    """True where the text says null."""
    return c == "null"


def text_optional(c: Column, convert) -> Column:
    """A struct (value, ok): `null` is None, other texts go through `convert`."""
    value = convert(c)
    return F.struct(F.when(c != "null", value).alias("value"), ((c == "null") | value.isNotNull()).alias("ok"))


def text_literal(c: Column, values: tuple) -> Column:
    """The text of the constant that a text means, by exact type: as JSON if it is such, else as it stands."""
    import json

    known = {json.dumps(v): json.dumps(v) for v in values} | {v: json.dumps(v) for v in values if isinstance(v, str)}
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), c)


def text_decimal(c: Column, precision: int = 38, scale: int = 18) -> Column:
    """Exact: null if the text has more digits than the type."""
    digits = F.length(F.regexp_replace(F.regexp_extract(c, r"\.([0-9]+)", 1), "0+$", ""))
    return F.when(c.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$") & (digits <= scale), c.try_cast(f"decimal({precision},{scale})"))


#: A decimal number, with an exponent or without; white space around it and underscores are gone.
DECIMAL = r"^([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]{1,4}))?$"


def _bare_number(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"^\s+|\s+$", ""), "_", "")


def json_decimal(c: Column, precision: int = 38, scale: int = 18) -> Column:
    """Exact, with exponents: null if the value has more digits than the type, and for what is no finite number."""
    bare = _bare_number(c)
    whole, part = F.regexp_extract(bare, DECIMAL, 2), F.regexp_extract(bare, DECIMAL, 3)
    power = F.coalesce(F.regexp_extract(bare, DECIMAL, 4).try_cast("int"), F.lit(0))
    digits = F.regexp_replace(F.concat(whole, part), "0+$", "")
    last = F.length(digits) - F.length(whole) - power  # places after the point that the value needs
    exact = bare.rlike(DECIMAL) & bare.rlike("[0-9]") & ~bare.rlike("^[+-]?[.]?[eE]") & ((digits == "") | (last <= scale))
    return F.when(c.rlike(r"^-?[0-9]{1,9}$"), c.try_cast(f"decimal({precision},{scale})")).when(exact, bare.try_cast(f"decimal({precision},{scale})"))


#: Digits that a number carried as text may have.
DIGITS = 4300


def whole_text(c: Column) -> Column:
    """An integer of any size in its canonical text; null for other texts."""
    return F.when(c == "-0", "0").when(c.rlike(f"^-?(0|[1-9][0-9]{{0,{DIGITS - 1}}})$"), c)


def exact_text(c: Column) -> Column:
    """A decimal number of any size as plain digits, all those after the point kept; null for other texts and exponents beyond 400."""
    def moved(n: Column) -> Column:
        """The digits on both sides of the point, which goes `power` places to the right."""
        power = n["power"]
        wide = F.lpad(n["whole"], F.greatest(F.length(n["whole"]), 1 - power), "0")
        kept = F.length(wide) + power
        left = F.when(power > 0, F.concat(n["whole"], F.rpad(F.substring(n["part"], F.lit(1), power), power, "0"))).when(power < 0, F.substring(wide, F.lit(1), kept)).otherwise(n["whole"])
        right = F.when(power > 0, F.substring(n["part"], power + 1, F.length(n["part"]))).when(power < 0, F.concat(F.substring(wide, kept + 1, -power), n["part"])).otherwise(n["part"])
        left = F.coalesce(F.nullif(F.regexp_replace(left, "^0+(?=[0-9])", ""), F.lit("")), F.lit("0"))
        return F.when(F.abs(power) <= 400, F.concat_ws(".", F.concat(n["sign"], left), F.nullif(right, F.lit(""))))

    def read(bare: Column) -> Column:
        parts = F.struct(F.regexp_replace(F.regexp_extract(bare, DECIMAL, 1), "[+]", "").alias("sign"), F.regexp_extract(bare, DECIMAL, 2).alias("whole"), F.regexp_extract(bare, DECIMAL, 3).alias("part"),
                         F.coalesce(F.regexp_extract(bare, DECIMAL, 4).try_cast("int"), F.lit(0)).alias("power"))
        good = bare.rlike(DECIMAL) & bare.rlike("[0-9]") & ~bare.rlike("^[+-]?[.]?[eE]") & (F.length(bare) <= DIGITS)
        return F.when(bare.rlike(r"^-?(0|[1-9][0-9]{0,37})(\.[0-9]{1,38})?$"), bare).when(good, _let(parts, moved))

    return _let(_bare_number(c), read)


def _size(c: Column) -> Column:
    """What orders the texts of `exact_text` that aren't negative: digits before the point, these, those after."""
    whole, part = F.substring_index(c, ".", 1), F.regexp_replace(F.regexp_extract(c, r"\.([0-9]*)$", 1), "0+$", "")
    return F.struct(F.length(whole).alias("n"), whole.alias("whole"), part.alias("part"))


def exact_over(c: Column, limit) -> Column:
    """Whether a number carried as text is above a number; equal ones are not."""
    return _exact_order(c, limit, lambda a, b: a > b)


def exact_under(c: Column, limit) -> Column:
    """Whether a number carried as text is below a number; equal ones are not."""
    return _exact_order(c, limit, lambda a, b: a < b)


def _exact_order(c: Column, limit, by) -> Column:
    from decimal import Decimal

    text = format(Decimal(str(limit)), "f")
    bound, low = _size(F.lit(text.lstrip("-"))), Decimal(text) < 0

    def order(n: Column) -> Column:
        here, below = _size(F.regexp_replace(n, "^-", "")), n.startswith("-") & n.rlike("[1-9]")
        if low:
            return F.when(below, by(bound, here)).otherwise(by(F.lit(1), F.lit(0)))
        return F.when(below, by(F.lit(0), F.lit(1))).otherwise(by(here, bound))

    return _let(c, order)


def non_finite_decimal(c: Column) -> Column:
    """Whether a text means an infinity or no number at all."""
    return _bare_number(c).rlike(r"(?i)^[+-]?(inf(inity)?|s?nan[0-9]*)$")


#: Dates: calendar and week, with hyphens and without.
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8}|[0-9]{4}-W[0-9]{2}(?:-[0-9])?|[0-9]{4}W[0-9]{2}[0-9]?"
#: Times: hours, minutes, seconds and a fraction of any length, with colons and without.
_TIME = r"(?:[0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?)?|[0-9]{4}(?:[0-9]{2}(?:[.,][0-9]+)?)?)"
_OFFSET = r"Z|[+-][0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?|[0-9]{2}(?:[0-9]{2})?)?"
ANY_DATE = f"^(?:{_DATE})$"
ANY_TIME = f"^T?({_TIME})({_OFFSET})?$"
ANY_INSTANT = f"^({_DATE})(?:[^0-9]({_TIME})({_OFFSET})?)?$"


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _with_groups(c: Column, pattern: str, groups: tuple[int, ...], then) -> Column:
    """`then` of some groups of a whole text that fits a pattern, all from one match; none of them may hold a semicolon."""
    parts = F.split(F.regexp_replace(c, pattern[:-1] + r"\R?$", ";".join(f"${k}" for k in groups)), ";")
    return _let(parts, lambda found: then(*[F.get(found, F.lit(k)) for k in range(len(groups))]))


def iso_date(c: Column) -> Column:
    """Calendar dates with hyphens and without, and week dates."""
    return _let(c, _iso_date)


def _iso_date(c: Column) -> Column:
    digits = F.regexp_replace(c, "-", "")
    year = F.substring(digits, 1, 4).try_cast("int")
    plain = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)).try_cast("date")
    week, day = F.regexp_extract(c, "W([0-9]{2})", 1).try_cast("int"), F.coalesce(F.regexp_extract(c, "W[0-9]{2}-?([0-9])$", 1).try_cast("int"), F.lit(1))
    fourth = F.concat(F.substring(digits, 1, 4), F.lit("-01-04")).try_cast("date")
    monday = _let(fourth, lambda f: F.date_sub(f, F.weekday(f)))

    def by_week(w: Column) -> Column:
        monday, week, day = w["monday"], w["week"], w["day"]
        return F.when(day.between(1, 7) & week.between(1, 53) & (F.weekofyear(F.date_add(monday, (week - 1) * 7)) == week), F.date_add(monday, (week - 1) * 7 + day - 1))

    of_week = _let(F.struct(monday.alias("monday"), week.alias("week"), day.alias("day")), by_week)
    return F.when(c.rlike(DAY), F.when(year > 0, c.try_cast("date"))).when(c.rlike(ANY_DATE) & (year > 0), F.when(c.contains("W"), of_week).otherwise(plain))


def _clock(t: Column) -> Column:
    """Microseconds of a time of day in one of the forms of _TIME; null out of range."""
    bare = F.regexp_replace(F.regexp_replace(t, "[.,].*$", ""), ":", "")
    micros = F.rpad(F.substring(F.regexp_extract(t, "[.,]([0-9]+)$", 1), 1, 6), 6, "0").try_cast("bigint")

    def parts(bare: Column) -> Column:
        part = lambda k: F.when(F.length(bare) >= k + 1, F.substring(bare, k, 2)).otherwise(F.lit("00")).try_cast("bigint")
        return F.array(part(1), part(3), part(5))

    def whole(p: Column) -> Column:
        hour, minute, second = (F.get(p, F.lit(k)) for k in range(3))
        return F.when((hour < 24) & (minute < 60) & (second < 60), ((hour * 60 + minute) * 60 + second) * 1_000_000 + F.coalesce(micros, F.lit(0)))

    return _let(_let(bare, parts), whole)


def _shift(offset: Column) -> Column:
    """Microseconds east of UTC; 0 without an offset, null from a day on."""
    micros = _clock(F.substring(offset, F.lit(2), F.length(offset)))
    return F.when(F.coalesce(offset, F.lit("")).isin("", "Z"), F.lit(0).cast("bigint")).otherwise(F.when(offset.startswith("-"), F.lit(-1)).otherwise(F.lit(1)) * micros)


def iso_datetime(c: Column, aware: bool = True) -> Column:
    """An instant, in UTC where the text has no offset; a wall clock if not `aware`, offsets then being refused.

    All forms of `iso_date` and of times, with any one character but a digit between; a date alone is its midnight.
    """
    return _let(c, lambda x: _iso_datetime(x, aware))


def _iso_datetime(c: Column, aware: bool) -> Column:
    def micros(date: Column, time: Column, offset: Column) -> Column:
        day = F.datediff(iso_date(date), F.lit("1970-01-01").cast("date")).cast("bigint")
        found = day * 86_400_000_000 + F.when(time == "", F.lit(0).cast("bigint")).otherwise(_clock(time)) - _shift(offset)
        return found if aware else F.when(offset == "", found)

    found = _with_groups(c, ANY_INSTANT, (1, 2, 3), micros)
    if aware:
        fast = F.when(c.rlike(INSTANT) & c.rlike(r"[+-]\d{2}:\d{2}$"), c.try_cast("timestamp"))
        return F.coalesce(fast, F.when(c.rlike(ANY_INSTANT), F.timestamp_micros(found)))
    fast = F.when(~c.rlike(r"(Z|[+-]\d{2}:\d{2})$"), c.try_cast("timestamp_ntz"))
    wall = F.timestamp_add("MICROSECOND", found, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.when(c.rlike(INSTANT), fast).when(c.rlike(ANY_INSTANT), wall)


def iso_time(c: Column) -> Column:
    """The canonical text of a time of day, with its offset if it has one."""
    two = lambda n: F.lpad(n.cast("bigint").cast("string"), 2, "0")
    clock = lambda n: F.concat_ws(":", two(F.floor(n / 3_600_000_000)), two(F.floor(n / 60_000_000) % 60), two(F.floor(n / 1_000_000) % 60))
    part = lambda n: F.when(n % 1_000_000 > 0, F.concat(F.lit("."), F.lpad((n % 1_000_000).cast("string"), 6, "0"))).otherwise(F.lit(""))

    def shown(time: Column, offset: Column) -> Column:
        return _let(F.struct(_clock(time).alias("micros"), _shift(offset).alias("east"), (offset == "").alias("bare")), text)

    def text(at: Column) -> Column:
        micros, east = at["micros"], at["east"]
        size = F.abs(east)
        zone = F.concat(F.when(east < 0, "-").otherwise("+"), F.substring(clock(size), 1, 5), F.when(size % 60_000_000 > 0, F.concat(F.lit(":"), two(F.floor(size / 1_000_000) % 60))).otherwise(F.lit("")), part(size))
        return F.when(micros.isNotNull() & east.isNotNull(), F.concat(clock(micros), part(micros), F.when(at["bare"], F.lit("")).otherwise(zone)))

    return _let(c, lambda x: F.when(x.rlike(ANY_TIME), _with_groups(x, ANY_TIME, (1, 2), shown)))


def duration_micros(c: Column) -> Column:
    """Microseconds of an ISO duration of days, hours, minutes and seconds; at least one part."""
    def micros(sign: Column, *parts: Column) -> Column:
        days, hours, minutes, seconds = (F.coalesce(p.try_cast("bigint"), F.lit(0)) for p in parts[:4])
        fraction = F.coalesce(F.rpad(parts[4], 6, "0").try_cast("bigint"), F.lit(0))
        return F.when(sign == "-", -1).otherwise(1) * ((((days * 24 + hours) * 60 + minutes) * 60 + seconds) * 1_000_000 + fraction)

    def found(c: Column) -> Column:
        good = c.rlike(DURATION) & c.rlike(r"[0-9][DHMS]") & ~c.rlike(r"T$")
        return F.when(good, _with_groups(c, DURATION, (1, 2, 4, 5, 6, 7), micros))

    return _let(c, found)


def iso_duration(c: Column) -> Column:
    micros = duration_micros(c)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000).cast("decimal(20,6)")).cast("decimal(18,6)"))


def format_duration(micros: Column) -> Column:
    """Canonical text: carries into days, hours and minutes, no zero parts, `PT0S` for zero."""
    over = lambda a, b: F.call_function("div", a, F.lit(b))
    part = lambda value, unit: F.when(value > 0, F.concat(value.cast("string"), F.lit(unit))).otherwise(F.lit(""))

    def text(micros: Column) -> Column:
        n = F.abs(micros)
        rest, fraction = n % 86_400_000_000, n % 1_000_000
        seconds = over(rest % 60_000_000, 1_000_000)
        shown = F.concat(seconds.cast("string"), F.when(fraction > 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(fraction.cast("string"), 6, "0"), "0+$", ""))).otherwise(F.lit("")))
        clock = F.concat(part(over(rest, 3_600_000_000), "H"), part(over(rest % 3_600_000_000, 60_000_000), "M"), F.when(n % 60_000_000 > 0, F.concat(shown, F.lit("S"))).otherwise(F.lit("")))
        days = F.concat(F.when(micros < 0, F.lit("-")).otherwise(F.lit("")), F.lit("P"), part(over(n, 86_400_000_000), "D"))
        return F.when(n == 0, F.lit("PT0S")).when(n > 0, F.concat(days, F.when(rest > 0, F.concat(F.lit("T"), clock)).otherwise(F.lit(""))))

    return _let(micros, text)


def canonical_uuid(c: Column) -> Column:
    """Braces, urn:uuid: and missing hyphens are accepted."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "urn:|uuid:", ""), r"^[{}]+|[{}]+$", ""), "-", ""))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def strict_base64(c: Column) -> Column:
    return F.when(c.rlike(BASE64), F.try_to_binary(c, F.lit("base64")))


def path_text(c: Column) -> Column:
    """Paths in normal form: no empty or `.` parts; two leading slashes stay two, more are one."""
    root = F.when(c.rlike("^//([^/]|$)"), "//").when(c.startswith("/"), "/").otherwise("")
    text = F.concat(root, F.array_join(F.filter(F.split(c, "/"), lambda p: ~p.isin("", ".")), "/"))
    return F.when(text == "", ".").otherwise(text)


IP_KINDS = ("IPv4Address", "IPv6Address", "IPv4Network", "IPv6Network", "IPv4Interface", "IPv6Interface")
_V4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _dotted(n: int) -> str:
    return ".".join(str(n >> k & 255) for k in (24, 16, 8, 0))


#: Masks as texts and the prefixes that they mean: net masks, then the host masks that aren't net masks too.
_MASKS = {_dotted(2**(32 - p) - 1): p for p in range(32, -1, -1)} | {_dotted(2**32 - 2**(32 - p)): p for p in range(33)}


def _v4_number(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p.try_cast("bigint"))


def _v6_groups(c: Column) -> Column:
    """The eight groups of an IPv6 address as hexadecimal texts without leading zeros; null if it is none."""
    groups = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))
    hexed = lambda n: F.concat_ws(":", F.lower(F.hex(F.floor(n / 65536))), F.lower(F.hex(n % 65536)))
    whole = lambda tail: F.when(tail == "", c).otherwise(F.concat(F.substring(c, F.lit(1), F.length(c) - F.length(tail)), hexed(_v4_number(tail))))
    halves = _let(F.regexp_extract(c, rf":({_V4})$", 1), lambda tail: F.transform(F.split(whole(tail), "::"), groups))

    def spread(h: Column) -> Column:
        left, right = F.get(h, F.lit(0)), F.get(h, F.lit(1))
        gap = 8 - F.size(left) - F.size(right)
        return F.when((F.size(h) == 2) & (gap >= 1), F.concat(left, F.array_repeat(F.lit("0"), gap), right)).when((F.size(h) == 1) & (F.size(left) == 8), left)

    sound = lambda all_: F.when(F.forall(all_, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")), F.transform(all_, lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", "")))
    return _let(_let(halves, spread), sound)


def _v6_text(groups: Column) -> Column:
    """Canonical text of eight groups: the first of the longest runs of zeros, of two at least, is left out."""
    def shortened(joined: Column) -> Column:
        out = F.when(joined.startswith("0:0:0:0:0:ffff:"), _let(F.split(joined, ":"), mapped))
        for k in range(8, 1, -1):
            run = rf"^(.*?)(?:^|:)0(?::0){{{k - 1}}}(?::|$)(.*)$"
            out = out.when(joined.rlike(run), F.regexp_replace(joined, run, "$1::$2"))
        return out.otherwise(joined)

    byte = lambda n: F.concat_ws(".", F.floor(n / 256).cast("string"), (n % 256).cast("string"))
    mapped = lambda g: F.concat(F.lit("::ffff:"), byte(F.conv(g[6], 16, 10).cast("int")), F.lit("."), byte(F.conv(g[7], 16, 10).cast("int")))
    return _let(F.array_join(groups, ":"), shortened)


def canonical_ip(kind: str):
    """A column function: canonical text of an address, network or interface; null if the text is none.

    Networks refuse host bits; masks may be prefixes or, of version 4, dotted.
    """
    four, form = kind.startswith("IPv4"), kind[4:]

    def address(c: Column) -> Column:
        if four:
            return F.when(c.rlike(f"^{_V4}$"), c)
        zone = F.regexp_extract(c, "(%[^%/]+)$", 1)
        bare = F.when(c.contains("%"), F.substring(c, F.lit(1), F.length(c) - F.length(zone))).otherwise(c)
        groups = _let(bare, _v6_groups)
        return F.when(c.contains(":"), F.concat(_let(groups, lambda g: F.when(g.isNotNull(), _v6_text(g))), zone))

    if form == "Address":
        return address

    def with_mask(c: Column) -> Column:
        parts = F.split(c, "/")
        host, mask = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        bits = 32 if four else 128
        number = F.when(mask.rlike("^[0-9]{1,9}$"), mask.try_cast("int"))
        if four:
            number = F.coalesce(number, F.element_at(F.create_map(*[F.lit(x) for kv in _MASKS.items() for x in kv]), mask))
        prefix = F.when(F.size(parts) == 1, F.lit(bits)).when((F.size(parts) == 2) & number.between(0, bits), number)
        text = F.concat(address(host), F.lit("/"), prefix.cast("string"))
        if form == "Interface":
            return text
        if four:
            bare = F.pmod(_v4_number(host), F.pow(F.lit(2), 32 - prefix).cast("bigint")) == 0
        else:
            free = lambda k: F.least(F.lit(16), F.greatest(F.lit(0), 16 * (k + 1) - prefix))
            bare = F.forall(F.transform(_let(F.regexp_replace(host, "%[^%/]+$", ""), _v6_groups), lambda g, k: F.conv(g, 16, 10).cast("bigint") % F.pow(F.lit(2), free(k)).cast("bigint") == 0), lambda b: b)
        return F.when(bare, text)

    return with_mask


def any_iso(kind: str):
    """A column function for every ISO form: the canonical text, or null."""
    if kind == "date":
        return lambda c: F.date_format(iso_date(c), "yyyy-MM-dd")
    if kind == "time":
        return iso_time
    return lambda c: F.date_format(iso_datetime(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def python_pattern(pattern: str, flags: int = 0):
    """A column function: whether a Python regular expression is found; for syntax that Java lacks."""
    found = re.compile(pattern, flags)

    @F.pandas_udf(T.BooleanType())
    def search(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: found.search(t) is not None, na_action="ignore").astype("boolean")

    return search
