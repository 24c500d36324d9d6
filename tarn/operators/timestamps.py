"""Mixed timestamp spellings and zones to one UTC instant.

Three steps.  :func:`read_values` reads each spelling into local microseconds, an optional offset or zone and a
precision (Arrow UDF, one pass, no zone rules).  :func:`estimate_zones` aligns zoneless local times of each group
with the times their rows were ingested: every candidate offset history is charged for the values it would put
after ingestion, and the history with the fewest violations, then the least total lag, is taken; a declared zone
always wins over an estimate.  :func:`to_utc` converts in the JVM under the chosen history: of two possible
instants the earlier, a skipped local time moved forward by the gap.

Defined results: null, blank, purely relative, impossible or unreadable values give a null instant, as do zoneless
values of rows whose group is null; a date alone is local midnight; absent seconds are zero; digits finer than
microseconds are cut off; repeated rows are converted independently; extra columns pass through untouched.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from functools import cache, lru_cache
from zoneinfo import available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.sources.tables import bounded_rows, join_small

READ = T.StructType([T.StructField("local_us", T.LongType()), T.StructField("offset_s", T.IntegerType()), T.StructField("zone", T.StringType())])

# Month names by their first letters, in the languages of the portals (lower case, accents kept).
MONTHS = {
    1: "january jan januar jän januari janvier janv enero ene janeiro gennaio gen styczeń stycznia sty января январь янв",
    2: "february feb februar februari février févr fevrier fev febrero fevereiro febbraio luty lutego lut февраля февраль фев",
    3: "march mar märz mär maerz mrz maart mrt mars marzo março marco marzec marca марта март мар",
    4: "april apr avril avr abril abr aprile kwiecień kwietnia kwi апреля апрель апр",
    5: "may mai mei mayo maio mag maggio maj maja мая май",
    6: "june jun juni juin junio junho giugno giu czerwiec czerwca cze июня июнь июн",
    7: "july jul juli juillet juil julio julho luglio lug lipiec lipca lip июля июль июл",
    8: "august aug augustus août aout agosto ago sierpień sierpnia sie августа август авг",
    9: "september sep sept septembre septiembre setembro set settembre wrzesień września wrz сентября сентябрь сен",
    10: "october oct oktober okt octobre octubre outubro out ottobre ott październik października paź октября октябрь окт",
    11: "november nov novembre noviembre novembro listopad listopada lis ноября ноябрь ноя",
    12: "december dec dezember dez décembre déc decembre diciembre dic dezembro dicembre grudzień grudnia gru декабря декабрь дек",
}
# Seconds east of UTC for zone abbreviations; where one means several zones, the row's portal decides first.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "z": 0, "wet": 0, "west": 3600, "bst": 3600, "cet": 3600, "cest": 7200, "mez": 3600, "mesz": 7200, "eet": 7200, "eest": 10800,
    "est": -18000, "edt": -14400, "cst": -21600, "cdt": -18000, "mst": -25200, "mdt": -21600, "pst": -28800, "pdt": -25200, "akst": -32400, "akdt": -28800,
    "hst": -36000, "ast": -14400, "adt": -10800, "nst": -12600, "ndt": -9000, "ist": 19800, "sgt": 28800, "hkt": 28800, "jst": 32400, "kst": 32400,
    "aest": 36000, "aedt": 39600, "acst": 34200, "acdt": 37800, "awst": 28800, "nzst": 43200, "nzdt": 46800, "msk": 10800,
}

_MONTH = {name: m for m, names in MONTHS.items() for name in names.split()}
_EPOCH = dt.datetime(1970, 1, 1)
_AGO = re.compile(r"(?:[,(;]|\s-)?\s*(?:about|over|almost)?\s*\(?(?:an?|\d+)\s*(?:seconds?|secs?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?)\s+ago\)?\s*$")
_BRACKET = re.compile(r"\s*\[([a-z_+\-0-9]+(?:/[a-z_+\-0-9]+)*)\]$")
_PAREN = re.compile(r"\s*\(([a-z_ +\-0-9:/]+)\)$")
_ZONE_NAME = re.compile(r"\s+([a-z]+(?:/[a-z_+\-]+)+)$")
_OFFSET = re.compile(r"\s*(?:utc|gmt)?\s*([+\-−])(\d{1,2})(?::?([0-5]\d))?$")
_ABBR = re.compile(r"(?:\s+|(?<=\d))([a-z]{1,5})(?=$)")
_ABBR_IN = re.compile(r"(?<=\d)\s+(utc|gmt|[a-z]{3,4})\s+(?=\d{4}$)")
_TIME = re.compile(r"(?<![\d.])(\d{1,2})\s*[:h]\s*(\d{2})(?:\s*[:m]\s*(\d{2})(?:[.,](\d+))?)?(?:\s*s\b)?\s*(?:uhr\b|hrs\b|h\b|u\b)?\s*([ap])?(?:(?<=[ap])\.?\s?m\b\.?)?")
_TIME_DOTS = re.compile(r"(?<=[\d.,] )(\d{1,2})\.(\d{2})(?:\.(\d{2})(?:[.,](\d+))?)?(?![\d.])\s*(?:uhr\b|h\b)?\s*([ap])?(?:(?<=[ap])\.?\s?m\b\.?)?")
_TIME_12 = re.compile(r"(?<![\d.:])(\d{1,2})\s*([ap])\.?\s?m\b\.?")
_ISO_TIME = re.compile(r"^(\d{4})-?(\d{2})-?(\d{2})t(\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?$")
_YMD = re.compile(r"(?<!\d)(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})日?(?!\d)")
_XXY = re.compile(r"(?<!\d)(\d{1,2})\s*([-/.])\s*(\d{1,2})\s*\2\s*(\d{4}|\d{2})(?!\d)")
_DAY_MONTH = re.compile(r"(?<!\d)(\d{1,2})(?:st|nd|rd|th|er|º|\.)?[\s\-/.]*(?:de\s+|of\s+|d')?([^\W\d_]{3,12})\.?[\s,\-/.]*(?:de\s+|del\s+)?'?(\d{4}|\d{2})(?![\d:])")
_MONTH_DAY = re.compile(r"([^\W\d_]{3,12})\.?\s*[\s\-/.]\s*(\d{1,2})(?:st|nd|rd|th)?\s*[,\s\-/.]\s*(\d{4})(?!\d)")
_MONTH_DAY_ONLY = re.compile(r"([^\W\d_]{3,12})\.?\s+(\d{1,2})(?:st|nd|rd|th)?(?!\d)")
_YEAR_MONTH = re.compile(r"(?<!\d)(\d{4})[\s\-/.,]+([^\W\d_]{3,12})\.?[\s\-/.,]+(\d{1,2})(?!\d)")
_WEEK = re.compile(r"^(\d{4})-?w(\d{2})-?([1-7])(?:[t ]|$)")
_ORDINAL = re.compile(r"^(\d{4})-(\d{3})(?:[t ]|$)")
_NUMBER = re.compile(r"^-?\d+(?:[.,]\d+)?$")
_DOTNET = re.compile(r"^/?\s*date\((-?\d+)([+-]\d{4})?\)\s*/?$")


@cache
def _zone_names() -> dict[str, str]:
    """IANA names by their lower-case form."""
    return {z.lower(): z for z in available_timezones() if "/" in z}


def _us(y: int, mo: int, d: int, h: int = 0, mi: int = 0, s: int = 0, frac: str = "") -> int | None:
    """Local microseconds; null if the parts name no real moment (24:00 is the next midnight, second 60 the next second)."""
    carry = dt.timedelta()
    if h == 24 and mi == 0 and s == 0:
        h, carry = 0, dt.timedelta(days=1)
    elif s == 60:
        s, carry = 59, dt.timedelta(seconds=1)
    try:
        when = dt.datetime(y, mo, d, h, mi, s) + carry
    except (ValueError, OverflowError):
        return None
    delta = when - _EPOCH
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + int((frac + "000000")[:6])


def _seconds(m: re.Match[str]) -> int:
    return (1 if m[1] == "+" else -1) * (int(m[2]) * 3600 + int(m[3] or 0) * 60)


def _clock(v: str) -> re.Match[str] | None:
    """The time of day in a value; dots only count after a date, where no colons are."""
    return _TIME.search(v) or _TIME_DOTS.search(v)


def _year(text: str) -> int:
    y = int(text)
    return y if len(text) > 2 else 2000 + y if y < 70 else 1900 + y


def _from_number(v: str) -> tuple[int | None, int | None] | None:
    """(local microseconds, offset) of a bare number: a compact date or an epoch count of its digits' unit."""
    whole, _, frac = v.replace(",", ".").partition(".")
    if len(whole) == 14 and not frac:
        return _us(*(int(x) for x in (whole[:4], whole[4:6], whole[6:8], whole[8:10], whole[10:12], whole[12:]))), None
    if len(whole) == 12 and not frac and whole[:2] in ("19", "20"):
        return _us(int(whole[:4]), int(whole[4:6]), int(whole[6:8]), int(whole[8:10]), int(whole[10:])), None
    if len(whole) == 8 and not frac and whole[:2] in ("19", "20"):
        return _us(int(whole[:4]), int(whole[4:6]), int(whole[6:])), None
    digits = len(whole.lstrip("-"))
    unit = {9: 1_000_000, 10: 1_000_000, 12: 1000, 13: 1000, 15: 1, 16: 1}.get(digits)
    if unit:
        return int(whole) * unit + int((frac + "000000")[:6]) * unit // 1_000_000, 0
    if digits in (18, 19):
        return int(whole) // 1000, 0
    return None


def _date(v: str, order: str) -> tuple[int, int, int] | None:
    if m := _YMD.search(v):
        return int(m[1]), int(m[2]), int(m[3])
    if m := _YEAR_MONTH.search(v):
        if mo := _MONTH.get(m[2]):
            return int(m[1]), mo, int(m[3])
    if m := _XXY.search(v):
        a, b, c = m[1], m[3], m[4]
        if order == "ymd" and len(c) == 2:
            return _year(a), int(b), int(c)
        first_is_month = order != "dmy"
        if order not in ("dmy", "mdy"):  # no order known for day and month: only a value over 12 tells
            if int(a) > 12:
                first_is_month = False
            elif int(b) <= 12 and a != b and order != "ymd":
                return None
        mo, d = (a, b) if first_is_month else (b, a)
        return _year(c), int(mo), int(d)
    for m in _DAY_MONTH.finditer(v):
        if mo := _MONTH.get(m[2]):
            return _year(m[3]), mo, int(m[1])
    for m in _MONTH_DAY.finditer(v):
        if mo := _MONTH.get(m[1]):
            return int(m[3]), mo, int(m[2])
    return None


def read_value(value: str | None, order: str | None) -> tuple[int | None, int | None, str | None]:
    """One spelling as (local microseconds, offset seconds, zone name); all null if it names no instant."""
    nothing = (None, None, None)
    if value is None:
        return nothing
    v = unicodedata.normalize("NFKC", value)
    v = re.sub(r"[​‎‏‪-‮⁠﻿]", "", v)
    v = re.sub(r"\s+", " ", v).strip().casefold().strip("\"'“”")
    if not any(c.isdigit() for c in v):
        return nothing
    if _NUMBER.match(v):
        got = _from_number(v)
        return (got[0], got[1], None) if got and got[0] is not None else nothing
    if m := _DOTNET.match(v):
        return int(m[1]) * 1000, 0, None
    v = _AGO.sub("", v).strip(" ,;")
    if not v:
        return nothing
    offset: int | None = None
    zone: str | None = None
    if m := _BRACKET.search(v):
        zone, v = m[1], v[: m.start()]
    elif m := _ZONE_NAME.search(v):
        zone, v = m[1], v[: m.start()]
    elif m := _PAREN.search(v):
        inner, rest = m[1].strip(), v[: m.start()]
        if inner in ABBREVIATIONS:
            zone, v = inner, rest
        elif "/" in inner:
            zone, v = inner, rest
        elif o := _OFFSET.fullmatch(" " + inner):
            offset, v = _seconds(o), rest
        else:
            v = rest
    has_time = bool(_clock(v)) or bool(re.search(r"t\d{4,6}", v))
    o = _OFFSET.search(v)
    if o and (before := v[: o.start()]) and (_clock(before) or re.search(r"t\d{4,6}(?:[.,]\d+)?$", before)) and re.search(r"\d{4}|[^\W\d_]{3}", before):
        offset, v, zone = _seconds(o), before, None
        if abs(offset) > 14 * 3600:
            return nothing
    elif zone is None:
        m = _ABBR.search(v) if has_time else None
        if m and m[1] in ABBREVIATIONS:
            zone, v = m[1], v[: m.start()]
        elif m := _ABBR_IN.search(v):
            if m[1] in ABBREVIATIONS:
                zone, v = m[1], v[: m.start()] + " " + v[m.end() :]
    elif (m := _ABBR.search(v)) and m[1] in ABBREVIATIONS:
        v = v[: m.start()]
    v = v.strip(" ,;")
    if zone in ("utc", "gmt", "z", "etc/utc", "etc/gmt"):
        offset, zone = 0, None
    if zone is not None and "/" in zone:
        zone = _zone_names().get(zone)
        if zone is None:
            return nothing
    if m := _ISO_TIME.match(v):
        us = _us(int(m[1]), int(m[2]), int(m[3]), int(m[4]), int(m[5]), int(m[6] or 0), m[7] or "")
        return (us, offset, zone) if us is not None else nothing
    h = mi = s = 0
    frac = ""
    rest = re.sub(r"(?<=\d)t(?=\d)", " ", v)
    if m := _clock(rest):
        h, mi, s, frac, half = int(m[1]), int(m[2]), int(m[3] or 0), m[4] or "", m[5]
        rest = rest[: m.start()] + " " + rest[m.end() :]
    elif m := _TIME_12.search(rest):
        h, half = int(m[1]), m[2]
        rest = rest[: m.start()] + " " + rest[m.end() :]
    else:
        half = None
    if half:
        if not 1 <= h <= 12:
            if h > 23 or half == "a":
                return nothing
        else:
            h = h % 12 + (12 if half == "p" else 0)
    rest = rest.strip(" ,;")
    if m := _WEEK.match(rest):
        try:
            day = dt.date.fromisocalendar(int(m[1]), int(m[2]), int(m[3]))
        except ValueError:
            return nothing
        parts = (day.year, day.month, day.day)
    elif (m := _ORDINAL.match(rest)) and 1 <= int(m[2]) <= 366:
        day = dt.date(int(m[1]), 1, 1) + dt.timedelta(days=int(m[2]) - 1)
        if day.year != int(m[1]):
            return nothing
        parts = (day.year, day.month, day.day)
    elif m := re.fullmatch(r"(\d{4})(\d{2})(\d{2})", rest):
        parts = (int(m[1]), int(m[2]), int(m[3]))
    else:
        got = _date(rest, order or "")
        if got is None:
            return nothing
        parts = got
    us = _us(*parts, h, mi, s, frac)
    return (us, offset, zone) if us is not None else nothing


@lru_cache(maxsize=50_000)
def read_cached(value: str | None, order: str | None) -> tuple[int | None, int | None, str | None]:
    """:func:`read_value`, remembering recent spellings of a Python worker."""
    return read_value(value, order)


@F.arrow_udf(READ)
def _read(values: pa.Array, orders: pa.Array) -> pa.Array:
    got = [read_cached(v, o) for v, o in zip(values.to_pylist(), orders.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays(
        [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())],
        names=["local_us", "offset_s", "zone"],
    )


def read_values(df: DataFrame, value: str, order: Column) -> DataFrame:
    """Adds ``read`` (local_us, offset_s, zone) of the spelling in column ``value``."""
    return df.withColumn("read", _read(F.col(value), order))


def _shift(local_us: Column, zone: Column | str) -> Column:
    """UTC microseconds of local microseconds under a zone's offset history."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))


#: Zones that portals may declare, at most; there are about 600 in all.
MAX_ZONES = 1000
#: The share of values by which a history may violate more than the best one.
SLACK = 0.005


def estimate_zones(reads: DataFrame, group: list[str], ingested: str, candidates: list[str]) -> DataFrame:
    """Per group the candidate offset history (a zone with its changes of offset) that fits its zoneless values best: the group's
    columns, ``est_zone, violations, n_values, lag_s``.

    A value later than its row's ingestion is a violation.  Histories with the fewest violations, or at most ``SLACK`` of the values
    more (single rows are wrong under any history), stay; of them the one with the smallest mean lag to ingestion is taken, as
    histories further west would violate; then the name decides.  One pass and one partial aggregation whatever the number of
    candidates; groups without zoneless values or without ingestion times are absent.
    """
    known = F.lit(True)
    for g in group:
        known = known & F.col(g).isNotNull()
    use = reads.where(F.col("read.local_us").isNotNull() & F.col("read.offset_s").isNull() & F.col("read.zone").isNull() & F.col(ingested).isNotNull() & known)
    lags = use.select(*group, *(((F.unix_micros(F.col(ingested).cast("timestamp")) - _shift(F.col("read.local_us"), F.lit(z))) / 1e6).alias(f"_{i}") for i, z in enumerate(candidates)))
    aggs = []
    for i in range(len(candidates)):
        lag = F.col(f"_{i}")
        aggs += [F.count_if(lag < 0).alias(f"v{i}"), F.avg(lag).alias(f"s{i}")]
    sums = lags.groupBy(*group).agg(F.count(F.lit(1)).alias("n_values"), *aggs)
    options = F.array(*(F.struct(F.round(f"s{i}").alias("lag_s"), F.lit(z).alias("zone"), F.col(f"v{i}").alias("violations")) for i, z in enumerate(candidates)))
    fewest = F.least(*(F.col(f"v{i}") for i in range(len(candidates))), F.col("n_values"))
    stay = F.filter(options, lambda o: o["violations"] <= F.col("_fewest") + F.col("n_values") * SLACK)
    best = sums.withColumn("_fewest", fewest).withColumn("best", F.array_min(stay))
    return best.select(*group, F.col("best.zone").alias("est_zone"), F.col("best.violations").alias("violations"), "n_values", F.col("best.lag_s").alias("lag_s"))


def to_utc(df: DataFrame, zone: Column) -> Column:
    """UTC microseconds of ``read``: by its offset, else its own zone or abbreviation, else ``zone``."""
    local, offset, own = F.col("read.local_us"), F.col("read.offset_s"), F.col("read.zone")
    names = F.create_map(*(x for z in ABBREVIATIONS for x in (F.lit(z), F.lit(ABBREVIATIONS[z]))))
    by_abbr = local - names[own].cast("bigint") * 1_000_000
    named = F.when(own.contains("/"), _shift(local, own))
    return F.coalesce(F.when(offset.isNotNull(), local - offset.cast("bigint") * 1_000_000), named, by_abbr, F.when(own.isNull(), _shift(local, zone)))


def normalise(df: DataFrame, value: str, portals: DataFrame, portal: str = "portal", ingested: str | None = None) -> DataFrame:
    """``df`` with ``utc_us`` of column ``value``; a column of that name is replaced, all others stay as they are.

    ``portals`` declares ``portal, zone, date_order``.  Portals it does not declare get the zone estimated from
    ``ingested``, where given; candidates are the declared zones.
    """
    dims = portals.groupBy(F.col("portal").alias("_portal")).agg(F.min("zone").alias("decl_zone"), F.min("date_order").alias("date_order")).where(F.col("_portal").isNotNull())
    kept = [c for c in df.columns if c != "utc_us"]
    packed = df.select(F.struct(*kept).alias("_row"), F.col(value).alias("_value"), F.col(portal).alias("_portal"), (F.col(ingested).cast("timestamp") if ingested else F.lit(None).cast("timestamp")).alias("_ingested"))
    reads = read_values(join_small(packed, dims, ["_portal"]), "_value", F.col("date_order"))
    zone = F.col("decl_zone")
    missing = ingested is not None and not df.where(F.col(portal).isNotNull()).select(F.col(portal).alias("_portal")).distinct().join(F.broadcast(dims.where("decl_zone is not null")), "_portal", "left_anti").isEmpty()
    if missing:  # else every portal declares its zone, and nothing is to be estimated
        unknown = reads.where(F.col("decl_zone").isNull())
        names = sorted({r["zone"] for r in bounded_rows(portals.select("zone").where(F.col("zone").isNotNull()).distinct(), MAX_ZONES, "portal zones")})
        if names:
            est = estimate_zones(unknown, ["_portal"], "_ingested", names).select("_portal", "est_zone")
            reads = join_small(reads, est, ["_portal"])
            zone = F.coalesce(F.col("decl_zone"), F.col("est_zone"))
    return reads.select("_row.*", to_utc(reads, zone).alias("utc_us"))
