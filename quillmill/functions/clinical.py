"""Values out of clinical free text: sizes, uptake, response, dates, stations, codes, times.

Column expressions over one row each, without UDFs. Null text counts as empty. What can't be read gives null,
unless a function states another result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import strip_all

# Patterns of sizes and uptake.
SIZE3 = r"(?i)(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*(cm|mm)?"
SIZE2 = r"(?i)(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*(cm|mm)"
SIZE1 = r"(?i)\b(\d+(?:\.\d+)?)\s*(cm|mm)\b"
SUV = r"(?i)SUV\s*(?:max(?:imum)?)?\s*[:=]?\s*(\d+(?:\.\d+)?)"
SUV_DELAYED = r"(?i)(?:increases?\s+to|delayed\s+SUV\s*(?:max(?:imum)?)?\s*[:=]?)\s*(\d+(?:\.\d+)?)"
SUV_ANY = r"(?i)\bSUV(?:\s*max(?:imum)?)?\b[^0-9]{0,12}(\d+(?:\.\d+)?)"
# Wording of change, each list in the order in which it is tried.
INCREASE = r"(?i)\b(?:increased|increase|enlarged|enlarging|new\s+lesion|new\s+node)\b"
DECREASE = r"(?i)\b(?:decreased|decrease|smaller|resolution|resolved|regression)\b"
STABLE = r"(?i)\b(?:stable|unchanged|similar|no\s+new\s+lesions?)\b"
CHANGES = {
    "New": r"(?i)\bnew\b",
    "Resolved": r"(?i)\bresolved|resolution\b",
    "Increased": r"(?i)\bincreased|enlarged|greater\b",
    "Decreased": r"(?i)\bdecreased|smaller|reduced\b",
    "Stable": r"(?i)\bstable|unchanged|similar\b",
}
# Nodal stations in their order.
STATIONS = ("2R", "2L", "3P", "4R", "4L", "5", "7", "8", "9", "10R", "10L", "11R", "11RS", "11RI", "11L", "11LS", "11LI", "12R", "12L", "LUNG MASS", "OTHER")
STATION = r"(?:^|[^0-9A-Z])(2R|2L|3P|4R|4L|5|7|8|9|10R|10L|11R|11L|12R|12L)([SI]?)(?:[^0-9A-Z]|$)"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def sizes_mm(text: Column) -> Column:
    """struct<a, b, c> in whole millimetres (halves to even): three axes if the text has them, else two, else one."""
    t, missing = _text(text), F.lit(None).cast("int")

    def axes(pattern: str, n: int) -> Column:
        factor = F.when(F.lower(F.regexp_extract(t, pattern, n + 1)) == "cm", 10.0).otherwise(1.0)
        mm = [F.bround(_number(t, pattern, k) * factor).cast("int") for k in range(1, n + 1)]
        return F.struct(*[x.alias(name) for name, x in zip("abc", [*mm, missing, missing], strict=False)])

    found = reduce(lambda c, x: c.when(t.rlike(x[0]), axes(*x)), [(SIZE2, 2), (SIZE1, 1)], F.when(t.rlike(SIZE3), axes(SIZE3, 3)))
    return found.otherwise(F.struct(*[missing.alias(name) for name in "abc"]))


def suv_values(text: Column) -> Column:
    """struct<suv, delayed>: the first of each."""
    return F.struct(_number(_text(text), SUV).alias("suv"), _number(_text(text), SUV_DELAYED).alias("delayed"))


def response(text: Column) -> Column:
    """Mixed, Progression, Response, Stable or Indeterminate."""
    t = _text(text)
    up, down = t.rlike(INCREASE), t.rlike(DECREASE)
    return F.when(up & down, "Mixed").when(up, "Progression").when(down, "Response").when(t.rlike(STABLE), "Stable").otherwise("Indeterminate")


def change(text: Column) -> Column:
    """The first label of CHANGES whose wording the text has."""
    t = _text(text)
    return F.coalesce(*[F.when(t.rlike(p), label) for label, p in CHANGES.items()])


def unique_value(values: Column, places: int = 1) -> Column:
    """The value that all of an array agree on after rounding (halves to even); null if there are none or several."""
    distinct = F.array_distinct(F.transform(values, lambda v: F.bround(v, places)))
    return F.when(F.size(distinct) == 1, F.try_element_at(distinct, F.lit(1)))


def agreed_suv(text: Column) -> Column:
    """The uptake of a text if all its mentions from 0 to 100 agree."""
    values = F.transform(F.regexp_extract_all(_text(text), F.lit(SUV_ANY), F.lit(1)), lambda v: v.try_cast("double"))
    return unique_value(F.filter(values, lambda v: v <= 100))


def size_bucket(mm: Column, width: int = 5) -> Column:
    """The lower bound of a size's bucket as text; empty where the size is null."""
    return F.coalesce((F.floor(mm / width) * width).cast("string"), F.lit(""))


def _ymd(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a real day. Years of two digits lie from 1969 to 2068."""
    y = year.try_cast("int")
    y = F.when(F.length(year) > 2, y).when(y < 69, y + 2000).otherwise(y + 1900)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat_ws("-", pad(y, 4), pad(month, 2), pad(day, 2)).try_cast("date").cast("string")


def _month(name: Column) -> Column:
    short = F.array(*[F.lit(m[:3]) for m in MONTHS])
    return F.array_position(short, F.substring(F.lower(name), 1, 3))


def iso_date(text: Column) -> Column:
    """A day as yyyy-MM-dd: month first if numeric, month names whole or of three letters.

    The whole text is read first, then the first numeric day inside it, then the first one like 03Nov17.
    """
    t = strip_all(_text(text))
    part = lambda s, pattern, k: F.regexp_extract(s, pattern, k)
    names = "|".join(f"{m}|{m[:3]}" for m in MONTHS)
    mdy, ymd = r"^(\d{1,2})(?:/(\d{1,2})/|-(\d{1,2})-)(\d{4}|\d{2})$", r"^(\d{4})(?:/(\d{1,2})/|-(\d{1,2})-)(\d{1,2})$"
    named, day_first = rf"(?i)^({names})\s+(\d{{1,2}}),\s+(\d{{4}})$", rf"(?i)^(\d{{1,2}})\s+({names})\s+(\d{{4}})$"
    short = rf"(?i)^(\d{{1,2}})({'|'.join(m[:3] for m in MONTHS)})(\d{{4}}|\d{{2}})$"

    def numeric(s: Column) -> Column:
        return F.when(s.rlike(mdy), _ymd(part(s, mdy, 4), part(s, mdy, 1), F.concat(part(s, mdy, 2), part(s, mdy, 3))))

    inside = F.regexp_extract(t, r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", 1)
    packed = F.regexp_extract(t, r"(\d{1,2}[A-Za-z]{3}\d{2,4})", 1)
    loose = F.coalesce(
        numeric(t),
        F.when(t.rlike(ymd), _ymd(part(t, ymd, 1), F.concat(part(t, ymd, 2), part(t, ymd, 3)), part(t, ymd, 4))),
        F.when(t.rlike(named), _ymd(part(t, named, 3), _month(part(t, named, 1)), part(t, named, 2))),
        F.when(t.rlike(day_first), _ymd(part(t, day_first, 3), _month(part(t, day_first, 2)), part(t, day_first, 1))),
        numeric(inside),
        F.when(packed.rlike(short), _ymd(part(packed, short, 3), _month(part(packed, short, 2)), part(packed, short, 1))))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date").cast("string")).otherwise(loose)


def station(text: Column) -> Column:
    """The canonical nodal station of a text. Bare digits need the whole text, "subcarinal" or "station" beside them."""
    upper = F.upper(_text(text))
    cleaned = F.regexp_replace(F.regexp_replace(strip_all(upper), r"^(STATION|STN|NODE)[\s:]*", ""), r"\s+", "")
    base, suffix = F.regexp_extract(cleaned, STATION, 1), F.regexp_extract(cleaned, STATION, 2)
    named = (cleaned == base) | cleaned.contains("SUBCARINAL") | upper.contains("STATION")
    return F.when(base == "", None).when(base.isin("11R", "11L"), F.concat(base, suffix)).when(base.isin("5", "7", "8", "9") & ~named, None).otherwise(base)


def sorted_stations(stations: Column) -> Column:
    """Upper case, each once, by the order of STATIONS; others after them by name."""
    tokens = F.array_distinct(F.filter(F.transform(F.array_compact(stations), lambda s: F.upper(strip_all(s))), lambda s: s != ""))
    rank = lambda s: F.array_position(F.array(*map(F.lit, STATIONS)), s)
    ranked = F.transform(tokens, lambda s: F.struct(F.when(rank(s) == 0, 999).otherwise(rank(s)).alias("rank"), s.alias("token")))
    return F.transform(F.array_sort(ranked), lambda x: x["token"])


def overall_result(details: Column) -> Column:
    """Of array<struct<station, result>>: the result all share; else Malignant if one is; else all of them in their order."""
    known = F.filter(details, lambda x: (x["station"] != "") & (x["result"] != ""))
    results = F.array_distinct(F.transform(known, lambda x: x["result"]))
    every = F.concat(F.lit("Mixed ("), F.array_join(F.transform(known, lambda x: F.concat(x["station"], F.lit(" "), x["result"])), "; "), F.lit(")"))
    return F.when(F.size(results) == 1, F.try_element_at(results, F.lit(1))).when(F.exists(results, lambda r: F.lower(r).contains("malignant")), "Malignant").when(F.size(results) > 1, every)


def procedure_codes(text: Column) -> Column:
    """All five-digit codes of a text with their modifiers, each once, in their order; null if it has none."""
    found = F.array_distinct(F.regexp_extract_all(_text(text), F.lit(r"\b(\d{5}(?:-\d{2})?)\b"), F.lit(1)))
    return F.when(F.size(found) > 0, found)


def bare_code(text: Column) -> Column:
    """A five-digit code without its add-on mark; null for any other text."""
    cleaned = strip_all(F.regexp_replace(strip_all(_text(text)), r"^\+", ""))
    return F.when(cleaned.rlike(r"^\d{5}$"), cleaned)


def list_items(text: Column) -> Column:
    """The items of a comma-separated text that aren't blank; null if there are none."""
    items = F.filter(F.transform(F.split(_text(text), ","), strip_all), lambda s: s != "")
    return F.when(F.size(items) > 0, items)


def clock_time(text: Column) -> Column:
    """930, 0930, 9:30 and 9:30 PM as HH:MM; null beyond 23:59."""
    pattern = r"(?i)^\s*(\d{1,2}):?(\d{2})\s*([AP]M)?\s*$"
    t = _text(text)
    hour, minute = _number(t, pattern, 1).cast("int"), _number(t, pattern, 2).cast("int")
    half = F.upper(F.regexp_extract(t, pattern, 3))
    h = F.when(hour.between(1, 12) & (half == "AM"), hour % 12).when(hour.between(1, 12) & (half == "PM"), hour % 12 + 12).otherwise(hour)
    return F.when((h <= 23) & (minute <= 59), F.format_string("%02d:%02d", h, minute))


def minutes_of_day(text: Column) -> Column:
    """Minutes since midnight of HH:MM (what follows a second colon isn't read)."""
    pattern = r"^\s*(\d+)\s*:\s*(\d+)\s*(?::.*)?$"
    hour, minute = _number(_text(text), pattern, 1).cast("int"), _number(_text(text), pattern, 2).cast("int")
    return F.when((hour <= 23) & (minute <= 59), hour * 60 + minute)


def duration_minutes(stated: Column, start: Column, end: Column) -> Column:
    """The stated minutes, else those from start to end, across midnight if the end is earlier."""
    return F.coalesce(stated.cast("int"), F.pmod(minutes_of_day(end) - minutes_of_day(start), F.lit(1440)))
