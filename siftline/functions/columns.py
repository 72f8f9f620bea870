"""Scalar functions over columns: addresses, keys, dates, names, notes.

Each takes a Column and gives a Column built from built-in expressions only, so
that it stays inside generated code.  None of them raises on odd input; what
has no result is NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)^\s+|\s+$"
ADDRESS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, BLANKS, "")


def usable(c: Column) -> Column:
    """Whether a text holds anything but white space; false for NULL."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def _address(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")


def url_host(c: Column) -> Column:
    """Lower-case host without port, user and the brackets of a numeric one, NULL where the text has none."""
    return F.nullif(F.lower(F.translate(F.regexp_extract(_address(c), ADDRESS, 1), "[]", "")), F.lit(""))


def url_path(c: Column) -> Column:
    """Path as written, without query, fragment and trailing parameters."""
    return F.regexp_replace(F.regexp_extract(_address(c), PATH, 1), r";[^/]*$", "")


def url_identity(c: Column) -> Column:
    """Host and path of an address: what is left when scheme, port, user, query, fragment and final slashes go."""
    return F.concat(url_host(c), F.regexp_replace(url_path(c), r"/+$", ""))


def source_of_host(host: Column, table: list[tuple[str, str]]) -> Column:
    """Source token of the first table row whose host equals or ends in it, else NULL."""
    if not table:
        return F.lit(None).cast("string")
    rules = [(host == k) | host.endswith("." + k) for k, _ in table]
    start = F.when(rules[0], table[0][1])
    return reduce(lambda acc, x: acc.when(x[0], x[1][1]), zip(rules[1:], table[1:], strict=True), start)


def infer_source(url: Column, table: list[tuple[str, str]]) -> Column:
    return source_of_host(url_host(url), table)


def source_matches(source: Column, url: Column, table: list[tuple[str, str]]) -> Column:
    """Whether some table row has this source and the address's host."""
    host = url_host(url)
    hits = [(source == token) & ((host == k) | host.endswith("." + k)) for k, token in table]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False)) if hits else F.lit(False)


def source_rank(source: Column, priority: list[str]) -> Column:
    """Position in the priority list, unknown and missing ones after every known one."""
    start = F.when(source == priority[0], 0) if priority else F.when(F.lit(False), 0)
    return reduce(lambda acc, x: acc.when(source == x[1], x[0]), list(enumerate(priority))[1:], start).otherwise(len(priority)).cast("int")


def effective_source(source: Column, url: Column, table: list[tuple[str, str]]) -> Column:
    """The stated source, else the one the address tells."""
    return F.coalesce(F.nullif(source, F.lit("")), infer_source(url, table))


def iso_date(c: Column) -> Column:
    """Date of the first ten characters in ISO form, else NULL."""
    return F.try_to_date(F.left(c, F.lit(10)), "yyyy-MM-dd")


def flexible_date(c: Column) -> Column:
    """Date of an ISO or English text; a range within one month counts as its first day."""
    t = F.regexp_replace(strip(c), r"(?U)\s+", " ")
    r = F.regexp_replace(t, r"^(\d{1,2}) ?[-–] ?\d{1,2} ([A-Za-z]+ \d{4})$", "$1 $2")
    forms = ["d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "MMM d, yyyy"]
    return F.coalesce(iso_date(t), F.try_to_date(F.when(t.rlike(r"^\d{8}$"), t), "yyyyMMdd"), *[F.try_to_date(r, f) for f in forms])


def epoch_ms_date(c: Column) -> Column:
    """UTC date of epoch milliseconds; values no calendar holds give NULL."""
    day = F.floor(c / 86400000)
    return F.when(day.between(-719162, 2932896), F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")))


def days_left(deadline: Column, as_of: Column, missing: int = 9999) -> Column:
    """Whole days from `as_of` to an ISO deadline."""
    return F.coalesce(F.datediff(iso_date(deadline), as_of), F.lit(missing))


def slug_of(name: Column, conf_date: Column, deadline: Column, as_of: Column) -> Column:
    """Key of a record: name in lower-case ASCII words, then the year it names or its dates name."""
    low = F.lower(strip(name))
    year = F.nullif(F.regexp_extract(low, r"(?<![\p{L}\p{N}_])(20\d{2})(?![\p{L}\p{N}_])", 1), F.lit(""))
    rest = F.when(year.isNull(), low).otherwise(F.regexp_replace(low, r"^(.*?)(?<![\p{L}\p{N}_])20\d{2}(?![\p{L}\p{N}_])", "$1"))
    base = F.regexp_replace(F.regexp_replace(rest, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.concat(base, F.lit("-"), F.coalesce(year, F.year(flexible_date(conf_date)).cast("string"), F.year(flexible_date(deadline)).cast("string"), F.year(as_of).cast("string")))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda x: x != "")


def last_segment(url: Column) -> Column:
    """Last part of the path; a text without a scheme is split whole."""
    whole = F.filter(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), lambda x: x != "")
    return F.try_element_at(F.when(url_host(url).isNull(), whole).otherwise(path_parts(url)), F.lit(-1))


def first_segment(url: Column) -> Column:
    """First part of the path; NULL without scheme or host."""
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") & url_host(url).isNotNull(), F.get(F.split(F.regexp_replace(url_path(url), r"^/+|/+$", ""), "/"), 0))


def cohort_slug(cohort: Column, slug: Column, url: Column) -> Column:
    """Key to fetch a row by: a new row's own, else the first part of its address's path."""
    return F.coalesce(F.when(cohort == "new", F.nullif(slug, F.lit(""))), F.nullif(first_segment(url), F.lit("")))


def name_of(slug: Column, url: Column) -> Column:
    """A readable name from a key, else the address's identity."""
    words = F.filter(F.split(F.regexp_replace(slug, r"(^|-)20\d\d$", ""), "-"), lambda w: w != "")
    made = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), " ")
    return F.coalesce(F.nullif(made, F.lit("")), url_identity(url))


def keyword_hit(keyword: Column, text: Column, short: int = 3) -> Column:
    """Whether a keyword is in a lower-case text: short ones as words of their own, longer ones anywhere."""
    k = F.lower(strip(keyword))
    escaped = F.regexp_replace(k, r"([^\p{L}\p{N}_])", r"\\$1")
    word = k.rlike(r"^[\p{L}\p{N}_](?:.*[\p{L}\p{N}_])?$") & F.regexp_like(text, F.concat(F.lit(r"(?:^|[^\p{L}\p{N}_])"), escaped, F.lit(r"(?:$|[^\p{L}\p{N}_])")))
    return F.when(k == "", False).when(F.length(k) <= short, word).otherwise(F.contains(text, k))


def haystack(name: Column, notes: Column) -> Column:
    return F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(notes, F.lit(""))))


def append_note(notes: Column, marker: Column, sep: str = " | ") -> Column:
    """Notes with a marker at their end, once."""
    n = F.coalesce(notes, F.lit(""))
    return F.when(F.contains(n, marker), n).when(n == "", marker).otherwise(F.concat(n, F.lit(sep), marker))


STALE = r"^\[stale since \d{4}-\d{2}-\d{2}\] ?"


def stale_prefix(notes: Column, as_of: Column) -> Column:
    """Notes led by one warning with this date; an older warning is replaced."""
    return F.concat(F.lit("[stale since "), F.date_format(as_of, "yyyy-MM-dd"), F.lit("] "), F.regexp_replace(F.coalesce(notes, F.lit("")), STALE, ""))


def strip_stale(notes: Column) -> Column:
    return F.regexp_replace(notes, STALE, "")


#: An ISO date, extended or basic, and what may follow it: time, fraction, Z or offset.
INSTANT = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[Tt ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(?:[zZ]|([+-])(\d{2}):?(\d{2})?)?)?$"


def utc_instant(c: Column) -> Column:
    """Naive UTC timestamp of an ISO date or instant (no zone: UTC), else NULL; the session's zone has no part in it."""
    c = F.when(c.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{8})(?:[^\d-]|$)"), c)
    part = lambda i: F.regexp_extract(c, INSTANT, i)
    num = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).cast("int"), F.lit(0))
    two = lambda i: F.lpad(part(i), 2, "0")
    local = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), two(4), F.lit(":"), two(5), F.lit(":"), two(6), F.lit("."), F.rpad(part(7), 6, "0")).try_cast("timestamp_ntz")
    minutes = F.when((num(9) < 24) & (num(10) < 60), F.when(part(8) == "-", -1).otherwise(1) * (num(9) * 60 + num(10)))
    return local - F.make_dt_interval(mins=minutes)


def open_until(end: Column, as_of: Column) -> Column:
    """Whether an ISO instant (no zone: UTC) lies after `as_of`, a naive UTC timestamp; false when it can't be read."""
    return F.coalesce(utc_instant(end) > as_of, F.lit(False))


def url_quoted(c: Column) -> Column:
    """Percent-encoded, slashes kept."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def truthy(c: Column) -> Column:
    """Any non-empty text, whatever it says."""
    return F.coalesce(c != "", F.lit(False))
