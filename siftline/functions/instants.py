"""Dates and times in many writings, brought to one unambiguous form.

Every writing is a template; all templates compile into one alternation whose
named groups give the components in a single match.  Calendar ranges are then
validated and the instant is assembled by integer day arithmetic, so neither the
session time zone nor a lenient parser can change a result.

Result of `normal_form` for one value:

* a value without a time of day -> ``YYYY-MM-DD``;
* a value with one -> ``YYYY-MM-DDTHH:MM:SSZ``, fractions cut off;
* NULL when the value is null, blank, a placeholder or very long junk, names an
  impossible date or time, lacks year or day, fits two dates, has a time but no
  known zone, or is a local time that its zone skips or has twice.
"""

from __future__ import annotations

import zoneinfo
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names and short forms in English, German, French and Spanish.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février fevrier févr fev febrero",
    3: "march mar märz maerz mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre decembre déc diciembre dic",
}
# Zone abbreviations with one common meaning, in minutes east of UTC.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "msk": 180, "jst": 540, "kst": 540, "est": -300, "edt": -240, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "aest": 600, "aedt": 660, "acst": 570,
    "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780, "npt": 345, "brt": -180, "sast": 120,
    "aoe": -720, "anywhereonearth": -720,
}

_DASH = r" ?(?:-|–|—|‒|/| to | bis | until ) ?"
_TIME = r"<h>{1,2}:<i>{2}(?::<s>{2}(?:[.,]\d+)?)?(?: ?(?<ap>[ap])\.?m\.?(?![a-z]))?"
_ZONE = r"(?: ?\(?(?:(?:utc|gmt)?(?<zs>[+−-])<zh>{1,2}(?::?<zm>{2})?|(?<za>[a-z]{1,5}|anywhere on earth)|(?<zn>[a-z_]+(?: ?/ ?[a-z0-9_+-]+)+))\)?)?"
_DOW = r"(?:[a-zäöüéáí]{2,11}\.?,? )?"
_NAME = r"(?<b>[a-zà-ÿ]{3,10})\.?"
_ORD = r"(?:st|nd|rd|th|er|\.)?"

#: Each writing: date part, and whether a time of day may follow it.
WRITINGS: list[tuple[str, bool]] = [
    (r"<y>{4}-<m>{1,2}-<d>{1,2}", True),
    (r"<y>{4}/<m>{1,2}/<d>{1,2}", True),
    (r"<y>{4}\.<m>{1,2}\.<d>{1,2}", True),
    (r"<d>{1,2}\.<m>{1,2}\.<y>{4}", True),
    (r"<p>{1,2}(?<sep>[/-])<q>{1,2}\k<sep><y>{4}", True),
    (rf"{_DOW}<d>{{1,2}}{_ORD}(?: |-| de | of ){_NAME}(?: |-|, ?| de | del )<y>{{4}}", True),
    (rf"{_DOW}{_NAME} <d>{{1,2}}{_ORD},? <y>{{4}}", True),
    (r"<y>{4}-?w<w>{2}-?<wd>{1}", False),
    (r"<y>{4}<m>{2}<d>{2}", False),
    (r"<y>{4}<m>{2}<d>{2}t<h>{2}:?<i>{2}(?::?<s>{2}(?:[.,]\d+)?)?" + _ZONE, False),
    (r"(?<es>\d{9,10})|(?<em>\d{12,13})", False),
    # ranges: the first day counts, the last one only has to exist
    (rf"<y>{{4}}-<m>{{2}}-<d>{{2}}{_DASH}<y2>{{4}}-<m2>{{2}}-<d2>{{2}}", False),
    (rf"<y>{{4}}/<m>{{2}}/<d>{{2}}{_DASH}<y2>{{4}}/<m2>{{2}}/<d2>{{2}}", False),
    (rf"<d>{{1,2}}\.?{_DASH}<d2>{{1,2}}\.<m>{{1,2}}\.<y>{{4}}", False),
    (rf"<d>{{1,2}}\.<m>{{1,2}}\.?{_DASH}<d2>{{1,2}}\.<m2>{{1,2}}\.<y>{{4}}", False),
    (rf"<d>{{1,2}}\.<m>{{1,2}}\.<y>{{4}}{_DASH}<d2>{{1,2}}\.<m2>{{1,2}}\.<y2>{{4}}", False),
    (rf"<d>{{1,2}}{_ORD}{_DASH}<d2>{{1,2}}{_ORD} (?:de )?{_NAME},? (?:de )?<y>{{4}}", False),
    (rf"<d>{{1,2}}{_ORD} (?:de )?{_NAME}{_DASH}<d2>{{1,2}}{_ORD} (?:de )?(?<b2>[a-zà-ÿ]{{3,10}})\.?,? (?:de )?<y>{{4}}", False),
    (rf"<d>{{1,2}}{_ORD} (?:de )?{_NAME} (?:de )?<y>{{4}}{_DASH}<d2>{{1,2}}{_ORD} (?:de )?(?<b2>[a-zà-ÿ]{{3,10}})\.?,? (?:de )?<y2>{{4}}", False),
    (rf"{_NAME} <d>{{1,2}}{_ORD}{_DASH}<d2>{{1,2}}{_ORD},? <y>{{4}}", False),
    (rf"{_NAME} <d>{{1,2}}{_ORD}{_DASH}(?<b2>[a-zà-ÿ]{{3,10}})\.? <d2>{{1,2}}{_ORD},? <y>{{4}}", False),
    (rf"{_NAME} <d>{{1,2}}{_ORD},? <y>{{4}}{_DASH}(?<b2>[a-zà-ÿ]{{3,10}})\.? <d2>{{1,2}}{_ORD},? <y2>{{4}}", False),
]

PARTS = "y m d b p q w wd es em y2 m2 d2 b2 h i s ap zs zh zm za zn".split()


@lru_cache(maxsize=1)
def alternation() -> tuple[str, str]:
    """The one pattern, and the replacement that lays its components side by side."""
    import re

    seen: dict[str, list[str]] = {p: [] for p in PARTS}
    alternatives = []
    for k, (text, timed) in enumerate(WRITINGS):
        if timed:
            text += rf"(?:(?:t|,? ?(?:at )?){_TIME}{_ZONE})?"
        mark = "x" + "abcdefghijklmnopqrstuvwxyz"[k]
        text = re.sub(r"(?<!\(\?)(?<!k)<(\w+)>(\{[\d,]+\})", r"(?<\1>\\d\2)", text)

        def name(hit: re.Match, mark: str = mark) -> str:
            if hit[1] in seen:
                seen[hit[1]].append(hit[1] + mark)
            return f"(?<{hit[1]}{mark}>"

        text = re.sub(r"\(\?<(\w+)>", name, text)
        alternatives.append(re.sub(r"\\k<(\w+)>", rf"\\k<\1{mark}>", text))
    pattern = "(?iu)^(?:" + "|".join(alternatives) + ")$"
    return pattern, "\u0001" + "\u0001".join("".join(f"${{{g}}}" for g in seen[p]) for p in PARTS)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers only."""
    shifted = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(shifted / 400)
    yoe = shifted - era * 400
    doy = F.floor((153 * F.pmod(m + 9, F.lit(12)) + 2) / 5) + d - 1
    return (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("bigint")


def _valid(y: Column, m: Column, d: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= longest)


def zones(spark: SparkSession) -> DataFrame:
    """(zone_key, zone): every IANA name that Python and the JVM both know; about 600 rows, fixed by the tz database."""
    known = set(zoneinfo.available_timezones()) - {"localtime", "Factory"}
    try:
        jvm = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())  # type: ignore[union-attr]
        known &= jvm
    except Exception:  # noqa: BLE001 - a remote session has no JVM handle; its names are the same ones
        known = {z for z in known if "/" in z or z in ("UTC", "GMT")}
    return spark.createDataFrame([(z.lower(), z) for z in sorted(known)], "zone_key string, zone string")


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def normal_form(df: DataFrame, text: str, zone: str | None = None, out: str = "normal_form") -> DataFrame:
    """Adds column `out`, the normal form of `text`; `zone` names a column with the zone of rows whose text has none.

    Keeps every row and column; working columns have names that no input column
    bears.  Ties and repeated rows get the same answer each.
    """
    k = "__inst_"
    while any(c.startswith(k) for c in df.columns):
        k += "_"
    pattern, parts = alternation()
    clean = F.trim(F.regexp_replace(F.col(f"`{text}`"), r"(?U)[\s\u200b\u200e\u200f\ufeff]+", " "))
    hit = F.regexp_replace(clean, pattern, parts)
    df = df.withColumn(k, F.when(hit.startswith("\u0001"), F.split(F.substr(hit, F.lit(2)), "\u0001")))

    df = df.withColumns({f"{k}t_{p}": F.nullif(F.get(F.col(k), i), F.lit("")) for i, p in enumerate(PARTS)})
    words = {"b", "b2", "ap", "zs", "za", "zn"}
    df = df.withColumns({f"{k}n_{p}": F.col(f"{k}t_{p}").cast("bigint") for p in PARTS if p not in words})

    def text_of(p: str) -> Column:
        return F.col(f"{k}t_{p}")

    def num(p: str) -> Column:
        return F.col(f"{k}n_{p}")

    names = [F.lit(x) for n, ws in MONTHS.items() for w in ws.split() for x in (w, n)]
    months = F.create_map(*names)
    month = lambda p, b: F.coalesce(num(p), F.try_element_at(months, F.lower(text_of(b))).cast("bigint"))
    p, q = num("p"), num("q")
    # a/b/y: the day is the part beyond 12; equal parts are one date; otherwise two dates fit
    m = F.when(p.isNotNull(), F.when(p > 12, q).when(q > 12, p).when(p == q, p)).otherwise(month("m", "b"))
    d = F.when(p.isNotNull(), F.when(p > 12, p).when(q > 12, q).when(p == q, q)).otherwise(num("d"))
    df = df.withColumns({k + "m": m, k + "d": d, k + "m2": month("m2", "b2")})
    m, m2 = F.col(k + "m"), F.col(k + "m2")
    # one year for both ends of a range: it is the last day's
    y = F.when(num("y2").isNull() & (m2 < m), num("y") - 1).otherwise(num("y"))
    zh, zm = num("zh"), F.coalesce(num("zm"), F.lit(0))
    shorts = F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])
    offset = F.when(zh.isNotNull(), F.when((zh <= 14) & (zm < 60), F.when(text_of("zs") == "+", 1).otherwise(-1) * (zh * 60 + zm)))
    short = F.replace(F.lower(text_of("za")), F.lit(" "), F.lit(""))
    offset = F.coalesce(offset, F.try_element_at(shorts, short).cast("bigint"))
    named = F.regexp_replace(F.lower(text_of("zn")), " ", "")
    own = F.regexp_replace(F.lower(F.col(f"`{zone}`")), r"(?U)\s+", "") if zone else F.lit(None).cast("string")
    in_text = text_of("zn").isNotNull() | text_of("za").isNotNull() | zh.isNotNull()
    # one plain column per component: structs would be inlined into every use by the optimizer
    parts_now = {
        "y": y, "y2": F.coalesce(num("y2"), num("y")), "m2": F.coalesce(m2, m), "d2": num("d2"), "w": num("w"), "wd": num("wd"),
        "h": num("h"), "i": num("i"), "s": F.coalesce(num("s"), F.lit(0)), "ap": F.lower(text_of("ap")),
        "epoch": F.coalesce(num("es"), F.floor(num("em") / 1000).cast("bigint")), "off": offset,
        "z": F.when(offset.isNull(), F.when(in_text, named).otherwise(own)),
    }
    df = df.withColumns({k + n: x for n, x in parts_now.items()})
    table = zones(df.sparkSession).select(F.col("zone_key").alias(k + "zk"), F.col("zone").alias(k + "zone"))
    df = df.join(F.broadcast(table), F.col(k + "z") == F.col(k + "zk"), "left")  # fixed size: the tz database

    c = lambda n: F.col(k + n)
    jan4 = days_from_civil(c("y"), F.lit(1), F.lit(4))
    next4 = days_from_civil(c("y") + 1, F.lit(1), F.lit(4))
    hour = F.when(c("ap").isNull(), c("h")).when(c("h").between(1, 12), c("h") % 12 + F.when(c("ap") == "p", 12).otherwise(0))
    df = df.withColumns({
        "%scivil" % k: days_from_civil(c("y"), c("m"), c("d")), "%slast" % k: days_from_civil(c("y2"), c("m2"), c("d2")),
        "%sjan" % k: F.when(c("w").isNotNull(), jan4), "%snext" % k: F.when(c("w").isNotNull(), next4), "%shour" % k: hour,
    })
    week1 = c("jan") - F.pmod(c("jan") + 3, F.lit(7))
    weeks = (c("next") - F.pmod(c("next") + 3, F.lit(7)) - week1) / 7
    day = F.when(c("w").isNotNull(), F.when((c("w") >= 1) & (c("w") <= weeks) & c("wd").between(1, 7), week1 + (c("w") - 1) * 7 + c("wd") - 1))
    ends = c("d2").isNull() | (_valid(c("y2"), c("m2"), c("d2")) & (c("last") >= c("civil")))
    day = day.when(c("w").isNull() & _valid(c("y"), c("m"), c("d")) & ends, c("civil"))
    df = df.withColumn(k + "day", day)
    time_ok = c("hour").between(0, 23) & c("i").between(0, 59) & c("s").between(0, 59)
    df = df.withColumn(k + "local", F.when(time_ok, c("day") * 86400 + c("hour") * 3600 + c("i") * 60 + c("s")))
    at, zn = F.col(k + "local"), F.col(k + "zone")
    shown = lambda s: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), zn))
    # the offsets a day before and after give the only instants that can show this local time
    one = at - (shown(at - 86400) - (at - 86400))
    two = at - (shown(at + 86400) - (at + 86400))
    df = df.withColumns({k + "one": one, k + "two": two})
    ok1, ok2 = shown(F.col(k + "one")) == at, shown(F.col(k + "two")) == at
    zoned = F.when(F.col(k + "one") == F.col(k + "two"), F.when(ok1, F.col(k + "one"))).when(ok1 & ~ok2, F.col(k + "one")).when(ok2 & ~ok1, F.col(k + "two"))
    instant = F.when(c("epoch").isNotNull(), c("epoch")).when(c("off").isNotNull(), at - c("off") * 60).otherwise(zoned)
    # the generator keeps a caller's filter on the result above it: pushed further down, it would be unfolded into every stage
    df = df.select("*", F.inline_outer(F.array(F.struct(c("day").alias(k + "date"), instant.alias(k + "t")))))
    t = F.col(k + "t")
    date = lambda n: F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int")).cast("string")
    sec = F.pmod(t, F.lit(86400))
    stamp = F.concat(date(F.floor(t / 86400)), F.lit("T"), _two(F.floor(sec / 3600)), F.lit(":"), _two(F.floor(sec / 60) % 60), F.lit(":"), _two(sec % 60), F.lit("Z"))
    result = F.when(c("h").isNull() & c("epoch").isNull(), date(c("date"))).otherwise(stamp)
    return df.withColumn(out, result).drop(*[c for c in df.columns if c.startswith(k)])
