"""Queries over the core operators, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import columns as C
from siftline.operators import gating, interests, maintain, resolve, verify
from siftline.plans.pipeline import listed
from siftline.sources.documents import feed_a_candidates, feed_b_candidates
from siftline.sources.store import cut_at
from siftline.sources.tables import read

# The config that these queries run with; on the test data it takes the place of a deployment's own.
AUTHORITY = "callboard-speaker-api"
HOSTS = [("callboard.example", AUTHORITY), ("devfeed.example", "devfeed.example"), ("beanconfs.example", "beanconfs.example")]
PRIORITY = ["beanconfs.example", AUTHORITY, "devfeed.example"]
AS_OF, NOW_MS = "2026-06-01", 1780272000000
REGIONS = ["Corvanda", "Himpal", "Ostrel"]
PREFIXES = ["Agile", "the mobile", "Cloud L"]
EXPIRABLE, HIDDEN = ["open", "approved"], ["sent", "dismissed"]
INTERESTS = [
    {"id": "java", "keywords": ["java", "jvm", "beans"], "sources": ["beanconfs"]},
    {"id": "cloud", "keywords": ["cloud", "k8s"], "sources": []},
    {"id": "ai", "keywords": ["ai", "robotics", "ml"], "sources": []},
    {"id": "workshop", "keywords": ["workshop heavy"], "sources": ["Callboard"]},
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Registers a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def as_of():
    return F.lit(AS_OF).cast("date")


# --- SQL building blocks ---------------------------------------------------------------
_U = "regexp_replace(regexp_replace({u}, '[\\t\\r\\n]', '', 'g'), '^[\\x00-\\x20]+', '')"
_A = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]*)"
_P = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def s_host(u: str) -> str:
    return f"nullif(lower(replace(replace(regexp_extract({_U.format(u=u)}, '{_A}', 1), '[', ''), ']', '')), '')"


def s_path(u: str) -> str:
    return f"regexp_replace(regexp_extract({_U.format(u=u)}, '{_P}', 1), ';[^/]*$', '')"


def s_identity(u: str) -> str:
    return f"({s_host(u)} || regexp_replace({s_path(u)}, '/+$', ''))"


def s_infer(u: str) -> str:
    h = s_host(u)
    return "CASE " + " ".join(f"WHEN {h} = '{k}' OR ends_with({h}, '.{k}') THEN '{t}'" for k, t in HOSTS) + " END"


def s_matches(s: str, u: str) -> str:
    h = s_host(u)
    return "coalesce(" + " OR ".join(f"({s} = '{t}' AND ({h} = '{k}' OR ends_with({h}, '.{k}')))" for k, t in HOSTS) + ", false)"


def s_rank(s: str) -> str:
    return f"CASE {s} " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PRIORITY)) + f" ELSE {len(PRIORITY)} END"


def s_iso(t: str) -> str:
    return f"(CASE WHEN regexp_matches(left({t}, 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(left({t}, 10) AS DATE) END)"


def s_strip(t: str) -> str:
    return f"regexp_replace({t}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def s_usable(t: str) -> str:
    return f"coalesce(regexp_matches({t}, '[^\\s\\p{{Z}}]'), false)"


def s_flex(t: str) -> str:
    c = f"regexp_replace({s_strip(t)}, '[\\s\\p{{Z}}]+', ' ', 'g')"
    r = f"regexp_replace({c}, '^(\\d{{1,2}}) ?[-–] ?\\d{{1,2}} ([A-Za-z]+ \\d{{4}})$', '\\1 \\2')"
    forms = ", ".join(f"try_strptime({r}, '{f}')::DATE" for f in ("%d %B %Y", "%B %d, %Y", "%d %b %Y", "%b %d, %Y"))
    return f"coalesce({s_iso(c)}, CASE WHEN regexp_matches({c}, '^\\d{{8}}$') THEN try_strptime({c}, '%Y%m%d')::DATE END, {forms})"


def s_eff(s: str, u: str) -> str:
    return f"coalesce(nullif({s}, ''), {s_infer(u)})"


def s_first(u: str) -> str:
    return f"CASE WHEN regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*://') AND {s_host(u)} IS NOT NULL THEN string_split(regexp_replace({s_path(u)}, '^/+|/+$', '', 'g'), '/')[1] END"


def s_name(slug: str, u: str) -> str:
    words = f"list_filter(string_split(regexp_replace({slug}, '(^|-)20\\d\\d$', ''), '-'), lambda w: w <> '')"
    return f"coalesce(nullif(array_to_string(list_transform({words}, lambda w: upper(w[1]) || lower(w[2:])), ' '), ''), {s_identity(u)})"


_RANKED = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY coalesce(user_actioned, false) DESC, coalesce(shown_in_brief, false) DESC, m DESC, r, slug) AS rn,
  count(*) OVER (PARTITION BY norm) AS n_group, count(*) FILTER (coalesce(user_actioned, false)) OVER (PARTITION BY norm) > 1 AS skipped
  FROM (SELECT *, {s_identity("cfp_url")} AS norm, {s_matches("source", "cfp_url")} AS m, {s_rank("source")} AS r FROM cfp_state) WHERE norm IS NOT NULL),
groups AS (SELECT * FROM ranked WHERE n_group > 1)
"""


def _state(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "cfp_state")


FILLS = ["name", "city", "conf_date"]


def _order() -> list:
    return resolve.winner_order(F.col("user_actioned"), F.col("shown_in_brief"), C.source_matches(F.col("source"), F.col("cfp_url"), HOSTS), C.source_rank(F.col("source"), PRIORITY), F.col("slug"))


def _identified(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).withColumn("norm", C.url_identity(F.col("cfp_url")))


def _noted(spark: SparkSession, d: str) -> DataFrame:
    frozen = F.coalesce("user_actioned", F.lit(False)) | F.coalesce("shown_in_brief", F.lit(False))
    return resolve.grouped(_identified(spark, d), "norm", _order(), "user_actioned", "ord", "slug", FILLS, "bot_notes", frozen)


# --- scalar functions -------------------------------------------------------------------
@query(f"SELECT ord, {s_identity('cfp_url')} AS norm, {s_host('cfp_url')} AS host FROM cfp_state")
def url_normalise(spark, d):
    u = F.col("cfp_url")
    return _state(spark, d).select("ord", C.url_identity(u).alias("norm"), C.url_host(u).alias("host"))


@query(f"SELECT ord, {s_infer('cfp_url')} AS inferred, {s_eff('source', 'cfp_url')} AS effective, {s_matches('source', 'cfp_url')} AS matches, CAST({s_rank('source')} AS INT) AS source_rank FROM cfp_state")
def source_inference(spark, d):
    s, u = F.col("source"), F.col("cfp_url")
    return _state(spark, d).select("ord", C.infer_source(u, HOSTS).alias("inferred"), C.effective_source(s, u, HOSTS).alias("effective"), C.source_matches(s, u, HOSTS).alias("matches"), C.source_rank(s, PRIORITY).alias("source_rank"))


@query(f"SELECT ord, {s_flex('conf_date')} AS conf_day, {s_flex('deadline')} AS due_day, {s_iso('deadline')} AS iso_due FROM cfp_state")
def flexible_date(spark, d):
    return _state(spark, d).select("ord", C.flexible_date(F.col("conf_date")).alias("conf_day"), C.flexible_date(F.col("deadline")).alias("due_day"), C.iso_date(F.col("deadline")).alias("iso_due"))


@query("SELECT entry_id, CASE WHEN untilDate BETWEEN -62135596800000 AND 253402300799999 THEN DATE '1970-01-01' + CAST(floor(untilDate / 86400000.0) AS INT) END AS until_day, CASE WHEN list_min(conf.date) BETWEEN -62135596800000 AND 253402300799999 THEN DATE '1970-01-01' + CAST(floor(list_min(conf.date) / 86400000.0) AS INT) END AS first_day FROM feed_a_entries")
def epoch_ms_date(spark, d):
    return read(spark, d, "feed_a_entries").select("entry_id", C.epoch_ms_date(F.col("untilDate")).alias("until_day"), C.epoch_ms_date(F.array_min("conf.date")).alias("first_day"))


@query(f"SELECT ord, CAST(coalesce(date_diff('day', DATE '{AS_OF}', {s_iso('deadline')}), 9999) AS INT) AS days_left FROM cfp_state")
def days_left(spark, d):
    return _state(spark, d).select("ord", C.days_left(F.col("deadline"), as_of()).alias("days_left"))


_LOW = s_strip("name")
@query(rf"""SELECT entry_id, trim(regexp_replace(CASE WHEN y = '' THEN low ELSE regexp_replace(low, '\b20\d{{2}}\b', '') END, '[^a-z0-9]+', '-', 'g'), '-') || '-' ||
  coalesce(nullif(y, ''), CAST(year({s_flex('"date"')}) AS VARCHAR), CAST(year({s_flex('cfpEndDate')}) AS VARCHAR), '2026') AS slug
  FROM (SELECT *, lower({_LOW}) AS low, regexp_extract(lower({_LOW}), '\b(20\d{{2}})\b', 1) AS y FROM feed_b_entries)""")
def slugify(spark, d):
    return read(spark, d, "feed_b_entries").select("entry_id", C.slug_of(F.col("name"), F.col("date"), F.col("cfpEndDate"), as_of()).alias("slug"))


@query(f"""SELECT arrival_id, {s_first('cfp_url')} AS first_part, CASE WHEN {s_host('cfp_url')} IS NULL THEN list_filter(string_split(regexp_replace(cfp_url, '[?#].*$', ''), '/'), lambda x: x <> '')[-1] ELSE list_filter(string_split({s_path('cfp_url')}, '/'), lambda x: x <> '')[-1] END AS last_part,
  coalesce(CASE WHEN cohort = 'new' THEN nullif(slug, '') END, nullif({s_first('cfp_url')}, '')) AS fetch_slug FROM cfp_intake""")
def address_keys(spark, d):
    u = F.col("cfp_url")
    return read(spark, d, "cfp_intake").select("arrival_id", C.first_segment(u).alias("first_part"), C.last_segment(u).alias("last_part"), C.cohort_slug(F.col("cohort"), F.col("slug"), u).alias("fetch_slug"))


@query(f"SELECT ord, {s_name('slug', 'cfp_url')} AS made_name FROM cfp_state")
def derive_name(spark, d):
    return _state(spark, d).select("ord", C.name_of(F.col("slug"), F.col("cfp_url")).alias("made_name"))


@query(rf"SELECT ord, CASE WHEN contains(n, 'Small room') THEN n WHEN n = '' THEN 'Small room' ELSE n || ' | Small room' END AS marked, '[stale since {AS_OF}] ' || regexp_replace(n, '^\[stale since \d{{4}}-\d{{2}}-\d{{2}}\] ?', '') AS warned FROM (SELECT ord, coalesce(bot_notes, '') AS n FROM cfp_state)")
def note_marks(spark, d):
    n = F.col("bot_notes")
    return _state(spark, d).select("ord", C.append_note(n, F.lit("Small room")).alias("marked"), C.stale_prefix(n, as_of()).alias("warned"))


@query("SELECT doc_id, replace(url_encode(coalesce(title, author, '-')), '%2F', '/') AS quoted FROM documents")
def url_quote(spark, d):
    return read(spark, d, "documents").select("doc_id", F.replace(F.replace(F.replace(C.url_quoted(F.coalesce("title", "author", F.lit("-"))), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")), F.lit("+"), F.lit("%20")).alias("quoted"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), 0) AS missing FROM events")
def json_props(spark, d):
    v = F.try_parse_json("props")
    return read(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.coalesce(F.try_variant_get(v, "$.missing", "bigint"), F.lit(0)).cast("bigint").alias("missing"))


_DAY = r"(\d{4}-\d{2}-\d{2}|\d{8})"
_HMS = r"(?:[Tt ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?)?"
_ISO = "^" + _DAY + _HMS + r"(?:(?:[zZ])|([+-])(\d{2}):?(\d{2})?)?$"


def _p(i: int) -> str:
    return f"regexp_extract(cfp_end_local, '{_ISO}', {i})"


def _n(i: int) -> str:
    return f"coalesce(try_cast(nullif({_p(i)}, '') AS INT), 0)"


#: Naive UTC instant of any ISO date or instant; a zone needs a time before it.
_UTC = f"""CASE WHEN regexp_matches(cfp_end_local, '{_ISO}') AND NOT ({_p(2)} = '' AND regexp_matches(cfp_end_local, '[zZ]$|[+-]\\d{{2}}:\\d{{2}}$')) AND {_n(7)} < 24 AND {_n(8)} < 60
  THEN try_cast(left(replace({_p(1)}, '-', ''), 4) || '-' || substr(replace({_p(1)}, '-', ''), 5, 2) || '-' || substr(replace({_p(1)}, '-', ''), 7, 2) || ' ' || lpad({_p(2)}, 2, '0') || ':' || lpad({_p(3)}, 2, '0') || ':' || lpad({_p(4)}, 2, '0') || '.' || rpad({_p(5)}, 6, '0') AS TIMESTAMP)
  - to_minutes((CASE WHEN {_p(6)} = '-' THEN -1 ELSE 1 END) * ({_n(7)} * 60 + {_n(8)})) END"""


@query(f"SELECT check_id, coalesce({_UTC} > TIMESTAMP '{AS_OF} 00:00:00', false) AS is_open FROM event_results")
def open_until(spark, d):
    return read(spark, d, "event_results").select("check_id", C.open_until(F.col("cfp_end_local"), F.lit(AS_OF + " 00:00:00").cast("timestamp_ntz")).alias("is_open"))


# --- filters and gates -------------------------------------------------------------------
_VIRTUAL = "|".join(gating.VIRTUAL)
@query(f"SELECT ord, coalesce(regexp_matches(lower(city), '{_VIRTUAL}'), false) OR coalesce(regexp_matches(lower(name), '{_VIRTUAL}'), false) OR NOT {s_usable('city')} AS is_virtual FROM cfp_state")
def virtual_filter(spark, d):
    return _state(spark, d).select("ord", gating.is_virtual(F.col("name"), F.col("city")).alias("is_virtual"))


@query("SELECT ord, city FROM cfp_state WHERE NOT (" + " OR ".join(f"contains(lower(coalesce(city, '')), '{r.lower()}')" for r in REGIONS) + ")")
def excluded_region(spark, d):
    return _state(spark, d).where(~gating.in_regions(F.col("city"), REGIONS)).select("ord", "city")


@query("SELECT ord, name FROM cfp_state WHERE NOT coalesce(" + " OR ".join(f"starts_with(lower(name), '{p.lower()}')" for p in PREFIXES) + ", false)")
def blocked_prefix_anti(spark, d):
    return gating.without_prefixes(_state(spark, d), "name", spark.createDataFrame([(p,) for p in PREFIXES], "p string")).select("ord", "name")


_HID = ", ".join(f"'{h}'" for h in HIDDEN)
@query(f"""SELECT i.arrival_id FROM (SELECT arrival_id, slug, strftime(received_at + INTERVAL 20 DAY, '%Y-%m-%d') AS deadline FROM cfp_intake) i LEFT JOIN cfp_state s ON i.slug = s.slug
  WHERE CASE WHEN s.status IN ({_HID}) THEN false WHEN s.status = 'remind' THEN coalesce(date_diff('day', DATE '{AS_OF}', CAST(i.deadline AS DATE)), 9999) <= coalesce(s.remind_before_days, 7) ELSE true END""")
def state_gate(spark, d):
    rows = read(spark, d, "cfp_intake").select("arrival_id", "slug", F.date_add(F.col("received_at").cast("date"), 20).cast("string").alias("deadline"))
    return gating.state_gate(rows, _state(spark, d), "slug", as_of(), HIDDEN, "remind").select("arrival_id")


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders u WHERE u.o_custkey = o.o_custkey AND u.o_orderpriority = '1-URGENT'
  AND CAST(o.o_orderdate AS DATE) <= CAST(u.o_orderdate AS DATE) + 10 AND CAST(o.o_orderdate AS DATE) + 4 >= CAST(u.o_orderdate AS DATE))""")
def overlap_anti(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    busy = orders.where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey", F.col("day").alias("start"), F.date_add("day", 10).alias("end"))
    return gating.overlapping(orders, F.col("day"), gating.CONFERENCE_DAYS, busy, ["o_custkey"]).select("o_orderkey")


#: The trips that candidates must not meet: every valid interval of the events once, whenever it starts.
_TRIPS = f"trips AS (SELECT a, b, min(check_id) AS check_id FROM (SELECT check_id, {s_iso('conf_start')} AS a, {s_iso('conf_end')} AS b FROM event_results) WHERE b >= a GROUP BY a, b)"


def _trips(spark: SparkSession, d: str) -> DataFrame:
    days = read(spark, d, "event_results").select("check_id", C.iso_date(F.col("conf_start")).alias("start"), C.iso_date(F.col("conf_end")).alias("end"))
    return days.where(F.col("end") >= F.col("start")).groupBy("start", "end").agg(F.min("check_id").alias("trip"))


_DAYS = f"""{_TRIPS}, met AS (SELECT day, arg_min(check_id, (a, check_id, b)) AS trip, min((a, check_id, b)) AS t FROM (SELECT DISTINCT {s_flex('conf_date')} AS day FROM cfp_state) d JOIN trips ON day <= b AND day + 4 >= a GROUP BY day)"""
_TRAVEL = "'Travel conflict: overlaps with ' || t[2] || ' (' || t[1] || ' – ' || t[3] || ').'"
_UNKNOWN = "Could not verify travel conflict — exact conference dates unknown."


@query(f"""WITH {_DAYS}, f AS (SELECT s.*, met.trip, status IN ('open', 'approved') AND met.trip IS NOT NULL AS hit, coalesce(bot_notes, '') AS n,
  CASE WHEN status IN ('open', 'approved') AND met.trip IS NOT NULL THEN {_TRAVEL.replace('t[', 'met.t[')} WHEN status IN ('open', 'approved') AND {s_flex('conf_date')} IS NULL THEN '{_UNKNOWN}' END AS x FROM cfp_state s LEFT JOIN met ON {s_flex('s.conf_date')} = met.day)
  SELECT ord, CAST(trip AS VARCHAR) AS trip, CASE WHEN hit THEN 'conflict' ELSE status END AS status, CASE WHEN x IS NULL THEN bot_notes WHEN contains(n, x) THEN n WHEN n = '' THEN x ELSE n || ' | ' || x END AS bot_notes FROM f""")
def trip_flags(spark, d):
    """Every state row with the earliest trip that it meets; open and approved ones that meet one become conflicts, those without an exact date get a caveat."""
    state = _state(spark, d).withColumn("day", C.flexible_date(F.col("conf_date")))
    # rows of one day meet the same trips: the interval join sees each day once
    met = gating.first_overlap(state.select("day").distinct(), "day", F.col("day"), gating.CONFERENCE_DAYS, _trips(spark, d).withColumn("trip", F.struct("trip", "start", "end")), "trip")
    rows = state.join(met, "day", "left")
    alive, t = F.coalesce(F.col("status").isin(EXPIRABLE), F.lit(False)), F.col("trip")
    hit = alive & t.isNotNull()
    note = F.when(hit, F.concat(F.lit("Travel conflict: overlaps with "), t["trip"].cast("string"), F.lit(" ("), t["start"].cast("string"), F.lit(" – "), t["end"].cast("string"), F.lit(").")))
    note = note.when(alive & F.col("day").isNull(), _UNKNOWN)
    return rows.select("ord", t["trip"].cast("string").alias("trip"), F.when(hit, "conflict").otherwise(F.col("status")).alias("status"), F.when(note.isNotNull(), C.append_note(F.col("bot_notes"), note)).otherwise(F.col("bot_notes")).alias("bot_notes"))


@query("""SELECT count(*) AS seen, count(slug) AS with_key, count(*) FILTER (slug IS NULL) AS skipped_no_key, count(*) FILTER (known) AS skipped_existing, count(*) FILTER (slug IS NOT NULL AND NOT known) AS new_keys
  FROM (SELECT i.slug, s.slug IS NOT NULL AS known FROM cfp_intake i LEFT JOIN (SELECT DISTINCT slug FROM cfp_state) s ON i.slug = s.slug)""")
def new_keys_report(spark, d):
    known = _state(spark, d).select("slug", F.lit(True).alias("known")).distinct()
    rows = read(spark, d, "cfp_intake").select("slug").join(known, "slug", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return rows.agg(F.count("*").alias("seen"), F.count("slug").alias("with_key"), F.count_if(F.col("slug").isNull()).alias("skipped_no_key"), F.count_if("known").alias("skipped_existing"), F.count_if(F.col("slug").isNotNull() & ~F.col("known")).alias("new_keys"))


@query("SELECT arrival_id, slug FROM cfp_intake i WHERE NOT EXISTS (SELECT 1 FROM cfp_state s WHERE s.slug = i.slug)")
def new_keys_anti(spark, d):
    return read(spark, d, "cfp_intake").join(_state(spark, d).select("slug"), "slug", "left_anti").select("arrival_id", "slug")


@query(f"""SELECT name, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY {s_strip('lower(name)')} ORDER BY feed, entry_id) AS rn FROM (SELECT 0 AS feed, entry_id, conf.name AS name FROM feed_a_entries UNION ALL SELECT 1, entry_id, name FROM feed_b_entries)) WHERE rn = 1""")
def first_seen_dedup(spark, d):
    a = read(spark, d, "feed_a_entries").select(F.lit(0).alias("feed"), "entry_id", F.col("conf.name").alias("name"))
    b = read(spark, d, "feed_b_entries").select(F.lit(1).alias("feed"), "entry_id", "name")
    return resolve.first_seen(a.unionByName(b), resolve.name_key(F.col("name")), [F.col("feed"), F.col("entry_id")]).select("name", "entry_id")


@query(f"""SELECT feed, slug, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY score DESC, feed, entry_id) AS rn FROM (SELECT *, {s_usable('city')}::INT + {s_usable('url')}::INT + {s_usable('conf_day')}::INT AS score FROM (
  SELECT 'a' AS feed, entry_id, {s_strip('lower(conf.name)')} AS slug, conf.location AS city, link AS url, CAST(list_min(conf.date) AS VARCHAR) AS conf_day FROM feed_a_entries UNION ALL SELECT 'b', entry_id, {s_strip('lower(name)')}, locationName, cfpLink, "date" FROM feed_b_entries))) WHERE rn = 1""")
def pool_merge(spark, d):
    key = lambda c: C.strip(F.lower(c))
    a = read(spark, d, "feed_a_entries").select(F.lit("a").alias("feed"), "entry_id", key(F.col("conf.name")).alias("slug"), F.col("conf.location").alias("city"), F.col("link").alias("url"), F.array_min("conf.date").cast("string").alias("conf_day"))
    b = read(spark, d, "feed_b_entries").select(F.lit("b").alias("feed"), "entry_id", key(F.col("name")).alias("slug"), F.col("locationName").alias("city"), F.col("cfpLink").alias("url"), F.col("date").alias("conf_day"))
    return resolve.most_complete(a.unionByName(b), "slug", ["city", "url", "conf_day"], [F.col("feed"), F.col("entry_id")]).select("feed", "slug", "entry_id")


# --- resolution ----------------------------------------------------------------------------
@query(f"WITH {_RANKED} SELECT ord, norm, rn = 1 AS is_winner, n_group, skipped FROM groups")
def url_winner(spark, d):
    return resolve.ranked(_identified(spark, d), "norm", _order(), F.col("user_actioned"), "ord").select("ord", "norm", "is_winner", "n_group", "skipped")


_FILL = " UNION ALL ".join(f"SELECT norm, '{f}' AS field_name, max(ord) FILTER (rn = 1) AS survivor, CASE WHEN bool_or({s_usable(f)}) FILTER (rn = 1) THEN max(ord) FILTER (rn = 1) WHEN NOT bool_or(coalesce(user_actioned, false)) FILTER (rn = 1) THEN min_by(ord, slug) FILTER ({s_usable(f)}) END AS donor FROM groups WHERE NOT skipped GROUP BY norm" for f in ("name", "city", "conf_date"))
@query(f"WITH {_RANKED} SELECT norm, survivor, field_name, donor FROM ({_FILL}) WHERE donor IS NOT NULL")
def gap_fill(spark, d):
    return resolve.inherited(resolve.grouped(_identified(spark, d), "norm", _order(), "user_actioned", "ord", "slug", FILLS), "norm", FILLS)


_FOLD = f"""RECURSIVE {_RANKED},
lost AS (SELECT norm, slug, bot_notes AS t, row_number() OVER (PARTITION BY norm ORDER BY slug) AS k FROM groups WHERE NOT skipped AND rn > 1 AND coalesce(bot_notes, '') <> ''),
fold AS (SELECT norm, ord AS survivor, coalesce(bot_notes, '') AS notes, 0::BIGINT AS n, 0::BIGINT AS k, coalesce(user_actioned, false) OR coalesce(shown_in_brief, false) AS frozen FROM groups WHERE NOT skipped AND rn = 1
  UNION ALL SELECT f.norm, f.survivor, CASE WHEN contains(f.notes, l.t) THEN f.notes ELSE f.notes || CASE WHEN f.notes = '' THEN '' ELSE ' | ' END || '[merged from ' || l.slug || ']: ' || l.t END, f.n + CASE WHEN contains(f.notes, l.t) THEN 0 ELSE 1 END, f.k + 1, f.frozen
  FROM fold f JOIN lost l ON f.norm = l.norm AND l.k = f.k + 1 AND NOT f.frozen)"""
@query(f"WITH {_FOLD} SELECT norm, survivor, max_by(notes, k) AS notes, max_by(n, k) AS n_merged FROM fold GROUP BY norm, survivor")
def note_fold(spark, d):
    return resolve.folded_notes(_noted(spark, d), "norm")


@query(f"""WITH {_FOLD} SELECT * FROM (SELECT count(*) FILTER (NOT skipped) AS groups_merged, coalesce(CAST(sum(n - 1) FILTER (NOT skipped) AS BIGINT), 0) AS rows_dropped, count(*) FILTER (skipped) AS groups_skipped FROM (SELECT norm, any_value(skipped) AS skipped, any_value(n_group) AS n FROM groups GROUP BY norm)),
  (SELECT coalesce(CAST(sum(n) AS BIGINT), 0) AS notes_merged FROM (SELECT max_by(n, k) AS n FROM fold GROUP BY norm)), (SELECT count(*) FILTER (donor <> survivor) AS fields_inherited FROM ({_FILL}) WHERE donor IS NOT NULL)""")
def dedup_report(spark, d):
    return resolve.merge_report(_noted(spark, d), FILLS)


@query(f"SELECT i.arrival_id, t.slug AS state_slug FROM cfp_intake i LEFT JOIN (SELECT {s_identity('cfp_url')} AS norm, min(slug) AS slug FROM cfp_state WHERE {s_identity('cfp_url')} IS NOT NULL GROUP BY 1) t ON {s_identity('i.cfp_url')} = t.norm")
def url_lookup(spark, d):
    probes = read(spark, d, "cfp_intake").select("arrival_id", C.url_identity(F.col("cfp_url")).alias("probe"))
    table = _state(spark, d).select(C.url_identity(F.col("cfp_url")).alias("norm"), "slug")
    return resolve.lookup(probes, "probe", table, "norm", "slug", "state_slug").select("arrival_id", "state_slug")


# --- verification ----------------------------------------------------------------------------
_ROUTE = f"""plan AS (SELECT *, CASE WHEN NOT ours THEN 'other' WHEN fetch_slug IS NULL THEN 'unverifiable' ELSE 'fetch' END AS route FROM (SELECT arrival_id, cohort, ours, CASE WHEN ours THEN coalesce(CASE WHEN cohort = 'new' THEN nullif(slug, '') END, nullif({s_first('cfp_url')}, '')) END AS fetch_slug
  FROM (SELECT *, coalesce({s_eff('source', 'cfp_url')} = '{AUTHORITY}', false) AS ours FROM cfp_intake)))"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return verify.routed(read(spark, d, "cfp_intake"), AUTHORITY, HOSTS)


@query(f"WITH {_ROUTE} SELECT arrival_id, fetch_slug, route FROM plan")
def route_three_way(spark, d):
    return _plan(spark, d).select("arrival_id", "fetch_slug", "route")


@query(f"WITH {_ROUTE} SELECT route, count(*) AS n_rows, count(DISTINCT fetch_slug) AS n_slugs FROM plan GROUP BY route")
def route_counts(spark, d):
    return _plan(spark, d).groupBy("route").agg(F.count("*").alias("n_rows"), F.count_distinct("fetch_slug").alias("n_slugs"))


_DECIDE = f"""{_ROUTE}, last AS (SELECT * FROM event_results QUALIFY row_number() OVER (PARTITION BY slug ORDER BY loaded_at DESC, check_id DESC) = 1),
flat AS (SELECT p.*, l.slug IS NULL OR coalesce(l.has_error, false) AS failed, coalesce(l.removed, false) AS gone, coalesce(NOT l.cfp_open, false) AS shut, coalesce(l.is_online, false) AS online, left(nullif(l.cfp_end_local, ''), 10) AS e FROM plan p LEFT JOIN last l ON p.fetch_slug = l.slug),
acted AS (SELECT *, CASE WHEN failed THEN 'verify_failed' WHEN gone THEN CASE WHEN cohort = 'new' THEN 'drop' ELSE 'dismiss' END WHEN shut THEN CASE WHEN cohort = 'new' THEN 'drop' WHEN e IS NULL THEN 'verify_failed' ELSE 'dismiss' END
  WHEN online THEN CASE WHEN cohort = 'new' THEN 'drop' ELSE 'dismiss' END WHEN e IS NULL THEN 'verify_failed' ELSE 'verified' END AS action FROM flat)"""


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    results = verify.last_results(read(spark, d, "event_results").withColumn("seen", F.struct("loaded_at", "check_id")), "slug", "seen")
    return verify.decided(_plan(spark, d), results)


@query(f"WITH {_DECIDE} SELECT arrival_id, action, CASE WHEN action IN ('drop', 'dismiss') THEN CASE WHEN gone THEN 'removed' WHEN shut THEN 'closed' WHEN online THEN 'online' END END AS reason, CASE WHEN action = 'verified' THEN e END AS new_deadline FROM acted")
def verdict(spark, d):
    return _decisions(spark, d).select("arrival_id", "action", "reason", "new_deadline")


@query(f"""WITH {_DECIDE} SELECT arrival_id, CASE WHEN action = 'verified' THEN nullif(cfp_end_local, '') END AS end_local, CASE WHEN action = 'dismiss' THEN CASE WHEN gone THEN '{verify.REMOVED}' WHEN shut THEN '{verify.CLOSED.split("%s")[0]}' || e || '{verify.CLOSED.split("%s")[1]}' ELSE '{verify.ONLINE}' END END AS note
  FROM (SELECT a.*, l.cfp_end_local FROM acted a LEFT JOIN last l ON a.fetch_slug = l.slug)""")
def verdict_notes(spark, d):
    return _decisions(spark, d).select("arrival_id", "end_local", "note")


@query(f"WITH {_DECIDE} SELECT " + ", ".join(f"count(*) FILTER (action = '{a}') AS n_{a}" for a in verify.ACTIONS) + " FROM acted")
def verdict_summary(spark, d):
    return verify.summary(_decisions(spark, d))


_EVID = f"""{_DECIDE}, ev AS (SELECT '{AS_OF}' AS run_date, count(*) AS cohort_size, count(DISTINCT fetch_slug) FILTER (route = 'fetch') AS slugs_expected, count(*) FILTER (action = 'verified') AS verified, count(*) FILTER (action = 'dismiss') AS dismissed, count(*) FILTER (action = 'drop') AS dropped, count(*) FILTER (action = 'verify_failed') AS verify_failed FROM acted WHERE route <> 'other')"""
@query(f"WITH {_EVID} SELECT *, slugs_expected > 0 AS live_call FROM ev")
def evidence_row(spark, d):
    return verify.evidence(_decisions(spark, d), AS_OF)


@query(f"WITH {_EVID} SELECT CASE WHEN run_date <> '{AS_OF}' THEN 'other-date' WHEN cohort_size = 0 THEN 'none-required' WHEN verified + dismissed + dropped >= 1 THEN 'live' ELSE 'no-evidence' END AS reason, cohort_size = 0 OR verified + dismissed + dropped >= 1 AS advance FROM ev")
def evidence_gate(spark, d):
    return gating.evidence_state(verify.evidence(_decisions(spark, d), AS_OF), as_of()).select("reason", "advance")


# --- maintenance -------------------------------------------------------------------------------
_OUT = f"""out AS (SELECT *, CASE WHEN NOT coalesce(status IN ('open', 'approved'), false) THEN 'other' WHEN coalesce(user_actioned, false) THEN 'skipped_protected' WHEN coalesce({s_eff('source', 'cfp_url')} = '{AUTHORITY}', false) THEN 'skipped_authority'
  WHEN {s_iso('deadline')} IS NULL THEN 'skipped_no_deadline' WHEN {s_iso('deadline')} >= DATE '{AS_OF}' THEN 'kept' ELSE 'expired' END AS outcome FROM cfp_state)"""


def _expired(spark: SparkSession, d: str):
    return maintain.expired(_state(spark, d), as_of(), AUTHORITY, HOSTS, EXPIRABLE)


@query(f"WITH {_OUT}, m AS (SELECT *, coalesce(bot_notes, '') AS n, 'Expired: deadline ' || left(deadline, 10) || ' passed.' AS x FROM out) SELECT ord, CASE WHEN outcome = 'expired' THEN 'expired' ELSE status END AS status, CASE WHEN outcome <> 'expired' THEN bot_notes WHEN contains(n, x) THEN n WHEN n = '' THEN x ELSE n || ' | ' || x END AS bot_notes, outcome FROM m")
def expire(spark, d):
    return _expired(spark, d)[0].select("ord", "status", "bot_notes", "outcome")


@query(f"WITH {_OUT} SELECT " + ", ".join(f"count(*) FILTER (outcome = '{k}') AS n_{k}" for k in ("expired", "skipped_protected", "skipped_authority", "skipped_no_deadline")) + " FROM out")
def expire_report(spark, d):
    return _expired(spark, d)[1]


@query(f"SELECT {s_eff('source', 'cfp_url')} AS source, count(*) AS n_rows, count(*) FILTER (coalesce(source <> '', false)) AS n_existing, count(*) FILTER (NOT coalesce(source <> '', false) AND {s_infer('cfp_url')} IS NOT NULL) AS n_filled FROM cfp_state GROUP BY 1")
def backfill_source_report(spark, d):
    return maintain.backfilled_source(_state(spark, d), HOSTS)[1]


_MADE = s_name("slug", "cfp_url")
@query(f"SELECT count(*) FILTER (NOT h AND NOT p AND made IS NOT NULL) AS n_filled, count(*) FILTER (h) AS n_named, count(*) FILTER (NOT h AND p) AS n_protected, count(*) FILTER (NOT h AND NOT p AND made IS NULL) AS n_remaining FROM (SELECT {s_usable('name')} AS h, coalesce(user_actioned, false) AS p, {_MADE} AS made FROM cfp_state)")
def backfill_name_report(spark, d):
    return maintain.backfilled_name(_state(spark, d))[1]


@query(f"SELECT ord, nullif({s_first('cfp_url')}, '') AS url_key, CASE WHEN nullif({s_first('cfp_url')}, '') IS NULL THEN 'missing' WHEN nullif({s_first('cfp_url')}, '') <> slug THEN 'drifted' ELSE 'ok' END AS finding FROM cfp_state WHERE source = '{AUTHORITY}'")
def key_drift(spark, d):
    return maintain.key_audit(_state(spark, d), AUTHORITY).select("ord", "url_key", "finding")


@query("SELECT count(*) AS n_rows, count(*) FILTER (schema_version IS DISTINCT FROM 1) AS n_stamped FROM cfp_state")
def schema_stamp(spark, d):
    return maintain.stamped(_state(spark, d), 1)[1]


@query("SELECT ord, slug FROM cfp_state WHERE schema_version = 1")
def version_gate(spark, d):
    return _state(spark, d).where(F.col("schema_version") == 1).select("ord", "slug")


@query("""SELECT coalesce(s.slug, i.slug) AS slug, CASE WHEN i.slug IS NULL OR (s.slug IS NOT NULL AND coalesce(s.user_actioned, false)) THEN s.cfp_url ELSE i.cfp_url END AS cfp_url,
  CASE WHEN i.slug IS NULL THEN 'untouched' WHEN s.slug IS NULL THEN 'inserted' WHEN coalesce(s.user_actioned, false) THEN 'skipped_protected' ELSE 'updated' END AS outcome
  FROM cfp_state s FULL JOIN (SELECT slug, min_by(cfp_url, arrival_id) AS cfp_url FROM cfp_intake WHERE slug IS NOT NULL AND cfp_url IS NOT NULL GROUP BY slug) i ON s.slug = i.slug""")
def guarded_upsert(spark, d):
    work = read(spark, d, "cfp_intake").where(F.col("slug").isNotNull() & F.col("cfp_url").isNotNull()).groupBy("slug").agg(F.min_by("cfp_url", "arrival_id").alias("cfp_url")).withColumn("user_actioned", F.lit(None).cast("boolean"))
    return maintain.guarded_upsert(_state(spark, d).select("slug", "cfp_url", "user_actioned"), work, "slug", "user_actioned").select("slug", "cfp_url", "outcome")


@query(f"""WITH {_DECIDE}, j AS (SELECT s.*, a.arrival_id, a.action, CASE WHEN a.action IN ('drop', 'dismiss') THEN CASE WHEN gone THEN 'removed' WHEN shut THEN 'closed' WHEN online THEN 'online' END END AS reason FROM acted a JOIN cfp_state s ON a.fetch_slug = s.slug),
  w AS (SELECT *, coalesce(user_actioned, false) AS frozen, NOT coalesce(user_actioned, false) AND (NOT coalesce(shown_in_brief, false) OR (action = 'dismiss' AND reason IN ('closed', 'online'))) AS writes FROM j)
  SELECT arrival_id, writes AS writes_status, NOT frozen AS writes_fields, CASE WHEN writes AND action = 'dismiss' THEN 'dismissed' ELSE status END AS new_status, CASE WHEN NOT frozen AND action <> 'verify_failed' THEN '{AS_OF}' ELSE last_verified END AS new_last_verified, CASE WHEN frozen THEN _verify_failed WHEN action = 'verify_failed' THEN true END AS new_failed FROM w""")
def write_priority(spark, d):
    rows = _decisions(spark, d).select("arrival_id", "action", "reason", "fetch_slug").join(_state(spark, d), F.col("fetch_slug") == F.col("slug"))
    return maintain.prioritised(rows, AS_OF).select("arrival_id", "writes_status", "writes_fields", "new_status", "new_last_verified", "new_failed")


_BLOCK = " OR ".join(f"starts_with(lower(name), '{p.lower()}')" for p in PREFIXES)
@query(f"SELECT ord, CASE WHEN source IN ('beanconfs.example') THEN 'approved' WHEN coalesce({_BLOCK}, false) THEN 'dismissed' ELSE 'judge' END AS tier FROM cfp_state")
def tier_routing(spark, d):
    blocked = F.lit(False)
    for p in PREFIXES:
        blocked |= F.lower("name").startswith(p.lower())
    return _state(spark, d).select("ord", maintain.tier(F.col("source"), F.col("name"), ["beanconfs.example"], blocked).alias("tier"))


def s_interest(i: dict) -> str:
    tests = []
    for k in i["keywords"]:
        tests.append(f"regexp_matches(t, '(?:^|[^\\p{{L}}\\p{{N}}_]){k}(?:$|[^\\p{{L}}\\p{{N}}_])')" if len(k) <= 3 else f"contains(t, '{k}')")
    return "CASE WHEN " + " OR ".join([*tests, *[f"contains(s, '{x.lower()}')" for x in i["sources"]]]) + f" THEN '{i['id']}' END"


@query("SELECT ord, array_to_string(list_filter([" + ", ".join(s_interest(i) for i in INTERESTS) + "], lambda x: x IS NOT NULL), ',') AS interests FROM (SELECT ord, lower(coalesce(name, '') || ' ' || coalesce(bot_notes, '')) AS t, lower(coalesce(source, '')) AS s FROM cfp_state)")
def interest_match(spark, d):
    found = interests.matched(_state(spark, d), "ord", "name", "bot_notes", "source", INTERESTS)
    return found.select("ord", F.array_join("interests", ",").alias("interests"))


# --- clocks and reports -----------------------------------------------------------------------
@query("""SELECT user_id, CASE WHEN last_run > TIMESTAMP '2024-01-28 12:00:00' THEN 'cursor_future' WHEN date_diff('second', last_run, TIMESTAMP '2024-01-28 12:00:00') >= 216000 THEN 'cadence_elapsed' ELSE 'within_cadence' END AS reason
  FROM (SELECT user_id, date_trunc('second', max(ts)) AS last_run FROM events GROUP BY user_id)""")
def cadence_gate(spark, d):
    last = read(spark, d, "events").groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_run"))
    return last.select("user_id", gating.cadence(F.to_timestamp(F.lit("2024-01-28T12:00:00Z")), F.col("last_run")).alias("reason"))


@query("""WITH p AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, event_type AS stage FROM events), c AS (SELECT run, min(pos) AS cut FROM p WHERE stage IN ('error', 'purchase') GROUP BY run)
  SELECT p.run, p.pos, p.stage FROM p LEFT JOIN c ON p.run = c.run WHERE c.cut IS NULL OR p.pos < c.cut""")
def cascade_invalidate(spark, d):
    from pyspark.sql import Window

    stages = read(spark, d, "events").select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint").alias("pos"), F.col("event_type").alias("stage"))
    return cut_at(stages, ["error", "purchase"]).select("run", "pos", "stage")


@query(f"SELECT CASE WHEN n <= 3 THEN 'now' WHEN n <= 7 THEN 'week' WHEN n <= 31 THEN 'month' ELSE 'later' END AS urgency, count(*) AS n_rows FROM (SELECT coalesce(date_diff('day', DATE '{AS_OF}', {s_iso('deadline')}), 9999) AS n FROM cfp_state) WHERE n >= 0 GROUP BY 1")
def urgency_buckets(spark, d):
    n = C.days_left(F.col("deadline"), as_of())
    return _state(spark, d).where(n >= 0).groupBy(gating.urgency(n).alias("urgency")).agg(F.count("*").alias("n_rows"))


@query(f"SELECT ord, coalesce(_verify_failed, false) OR {s_iso('last_verified')} IS NULL OR date_diff('day', {s_iso('last_verified')}, DATE '{AS_OF}') > 7 AS suppressed FROM cfp_state")
def stale_guardrail(spark, d):
    return _state(spark, d).select("ord", gating.is_stale(F.col("last_verified"), F.col("_verify_failed"), as_of()).alias("suppressed"))


@query("SELECT status, count(*) AS n_rows, count(*) FILTER (coalesce(user_actioned, false)) AS n_actioned, count(*) FILTER (coalesce(_verify_failed, false)) AS n_failed, count(*) FILTER (coalesce(stale, false)) AS n_stale, max(updated) AS last_updated FROM cfp_state GROUP BY status")
def run_report(spark, d):
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return _state(spark, d).groupBy("status").agg(F.count("*").alias("n_rows"), yes("user_actioned").alias("n_actioned"), yes("_verify_failed").alias("n_failed"), yes("stale").alias("n_stale"), F.max("updated").alias("last_updated"))


# --- the flagship: discovery to a filtered, deduplicated, ordered list ------------------------
_CAND = f"""cand AS (SELECT 0 AS feed, entry_id AS ord, conf.name AS name, coalesce(conf.location, '') AS city, CASE WHEN list_min(conf.date) BETWEEN -62135596800000 AND 253402300799999 THEN strftime(DATE '1970-01-01' + CAST(floor(list_min(conf.date) / 86400000.0) AS INT), '%Y-%m-%d') END AS conf_date,
  coalesce(nullif(link, ''), conf.hyperlink) AS cfp_url, CASE WHEN untilDate BETWEEN -62135596800000 AND 253402300799999 THEN strftime(DATE '1970-01-01' + CAST(floor(untilDate / 86400000.0) AS INT), '%Y-%m-%d') END AS deadline FROM feed_a_entries WHERE untilDate > {NOW_MS} AND {s_usable('conf.name')}
  UNION ALL SELECT 1, entry_id, name, coalesce(locationName, ''), strftime({s_flex('"date"')}, '%Y-%m-%d'), {s_strip('cfpLink')}, strftime({s_flex('cfpEndDate')}, '%Y-%m-%d') FROM feed_b_entries WHERE {s_usable('name')} AND {s_usable('cfpLink')} AND {s_flex('cfpEndDate')} >= DATE '{AS_OF}'),
slugged AS (SELECT *, trim(regexp_replace(CASE WHEN y = '' THEN low ELSE regexp_replace(low, '\\b20\\d{{2}}\\b', '') END, '[^a-z0-9]+', '-', 'g'), '-') || '-' || coalesce(nullif(y, ''), CAST(year({s_flex('conf_date')}) AS VARCHAR), CAST(year({s_flex('deadline')}) AS VARCHAR), '2026') AS slug,
  coalesce(date_diff('day', DATE '{AS_OF}', {s_iso('deadline')}), 9999) AS days_left FROM (SELECT *, lower({_LOW}) AS low, regexp_extract(lower({_LOW}), '\\b(20\\d{{2}})\\b', 1) AS y FROM cand)),
{_TRIPS},
kept AS (SELECT c.* FROM slugged c LEFT JOIN cfp_state s ON c.slug = s.slug
  WHERE NOT (coalesce(regexp_matches(lower(c.city), '{_VIRTUAL}'), false) OR regexp_matches(lower(c.name), '{_VIRTUAL}') OR NOT {s_usable('c.city')})
  AND NOT ({" OR ".join(f"contains(lower(c.city), '{r.lower()}')" for r in REGIONS)}) AND days_left >= 0 AND NOT EXISTS (SELECT 1 FROM trips t WHERE {s_iso('c.conf_date')} <= t.b AND {s_iso('c.conf_date')} + 4 >= t.a)
  AND NOT ({" OR ".join(f"starts_with(lower(c.name), '{p.lower()}')" for p in PREFIXES)}) AND CASE WHEN s.status IN ({_HID}) THEN false WHEN s.status = 'remind' THEN days_left <= coalesce(s.remind_before_days, 7) ELSE true END)"""


def _candidates(spark: SparkSession, d: str, trips: DataFrame) -> DataFrame:
    a = feed_a_candidates(read(spark, d, "feed_a_entries"), F.lit(NOW_MS), "entry_id").withColumn("feed", F.lit(0))
    b = feed_b_candidates(read(spark, d, "feed_b_entries"), as_of(), "entry_id").withColumn("feed", F.lit(1))
    return listed(a.unionByName(b), _state(spark, d), trips, AS_OF, REGIONS, PREFIXES, HIDDEN)


@query(f"WITH {_CAND} SELECT ord, name, city, conf_date, cfp_url, deadline, slug, CAST(days_left AS INT) AS days_left FROM (SELECT *, row_number() OVER (PARTITION BY {s_strip('lower(name)')} ORDER BY feed, ord) AS rn FROM kept) WHERE rn = 1")
def cfp_pipeline(spark, d):
    return _candidates(spark, d, _trips(spark, d))
