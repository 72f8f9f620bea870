"""Problem 6: new batches checked for duplicates against everything accepted before.

A segment index for edit distance: the name part of every accepted key is cut
into TAU + 1 segments that are stored by year, kind, length and position; a new
key within TAU edits must share at least one of them unchanged, so a batch
probes only the substrings that can line up, checks the edit distance of what it
finds, and appends the segments of writings the index doesn't hold yet.  The
index lives in its folder: any later session goes on from there.  Files are laid
out by year and bucket of the segment, and a batch reads only the buckets of the
years it probes: accepted texts are never parsed again.

A key is read from the slug and, where the address holds one, from the address:
year, kind of event, name, place.  Different years never match, different kinds
or places never match; a missing place matches the one place of that name and
year.  An address that names its year, or is backed by the slug's year, matches
by its identity (host and path) too.  A name of fewer than 8 letters may differ
by one edit per 4 letters only: two would make another word of it.

Defined results: a row without slug and address, or whose values give no key,
has no duplicates and enters no index; a row without a batch is in no batch and
has no duplicates either; repeated rows within one batch are not compared with
each other and get one answer; ties go to fewer edits, then to the smaller id;
very long keys are handled whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators.skew import removed, salted_join, shared_folder
from siftline.sources.tables import read

TAU = 2
#: Words that say nothing about which edition a key names.
FILLERS = frozenset("the cfp call for papers event of".split())
#: Kinds of event, longer writings of one kind first.
KINDS = {
    "conference": "conf", "conf": "conf", "conventionx": "conx", "conferencex": "conx", "conx": "conx", "convention": "con", "con": "con", "festival": "fest", "fest": "fest",
    "summit": "summit", "week": "week", "bootcamp": "camp", "camp": "camp", "developerdays": "days", "days": "days", "expo": "expo", "forum": "forum",
    "meetup": "meetup", "unplugged": "unplugged", "world": "world", "symposium": "symposium", "workshop": "workshop", "congress": "congress",
}
#: Last path parts that lead to the same page as without them.
PAGES = frozenset("en de fr es apply submit speakers speaker index".split())

_URL = re.compile(r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)", re.I)
_YEAR = re.compile(r"^(?:20)?([0-4]\d)$")


def key_of(text: str | None) -> tuple[str, str, str, str] | None:
    """(year, kind, name, place) of a key such as ``agile-name-conf-place-2027``, or None without a year or a name."""
    if not text:
        return None
    year, words = None, []
    for w in re.findall(r"[^\W_]+", text.lower()):
        hit = re.fullmatch(r"([^\d]+)(20[0-4]\d|[0-4]\d)", w)
        if _YEAR.match(w):
            year = "20" + w[-2:]
        elif hit:
            words.append(hit[1])
            year = "20" + hit[2][-2:]
        else:
            words.append(w)
    words = [w for w in words if w not in FILLERS]
    if year is None or not words:
        return None
    joined, n = [], 0
    while n < len(words):  # two words that are one kind
        two = words[n] + words[n + 1] if n + 1 < len(words) else ""
        if two in KINDS and words[n] + words[n + 1] in ("conx", "conventionx", "conferencex", "developerdays"):
            joined.append(two)
            n += 2
        else:
            joined.append(words[n])
            n += 1
    for i in range(1, len(joined)):  # a word of its own, after the name
        if joined[i] in KINDS:
            return year, KINDS[joined[i]], "".join(joined[:i]), "".join(joined[i + 1 :])
    for i, w in enumerate(joined):  # grown together with the name or the place
        for k in KINDS:
            if len(w) >= len(k) + 4 and w.endswith(k):
                return year, KINDS[k], "".join(joined[:i]) + w[: -len(k)], "".join(joined[i + 1 :])
            if i and len(w) >= len(k) + 4 and w.startswith(k):
                return year, KINDS[k], "".join(joined[:i]), w[len(k) :] + "".join(joined[i + 1 :])
    for i in range(1, len(joined)):  # one letter off
        for k in KINDS:
            if len(k) > 3 and abs(len(k) - len(joined[i])) <= 1 and one_edit(joined[i], k):
                return year, KINDS[k], "".join(joined[:i]), "".join(joined[i + 1 :])
    return year, "", "".join(joined), ""


def one_edit(a: str, b: str) -> bool:
    """One letter more, less, other, or two neighbours swapped."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    x, y = a[n:], b[n:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and len(y) > 1 and x[2:] == y[2:])


def segments(name: str) -> list[tuple[int, int, str]]:
    """(position number, start, text) of the TAU + 1 segments; the last ones take the letters left over."""
    n, base = len(name), len(name) // (TAU + 1)
    cut, out = 0, []
    for i in range(TAU + 1):
        size = base + (1 if i >= TAU + 1 - n % (TAU + 1) else 0)
        out.append((i, cut, name[cut : cut + size]))
        cut += size
    return out


def probes(name: str) -> set[tuple[int, int, str]]:
    """(length, position number, text) of every index segment that a name within TAU edits may share unchanged."""
    found, n = set(), len(name)
    for other in range(max(1, n - TAU), n + TAU + 1):
        shift = n - other
        for i, start, text in segments("x" * other):
            size = len(text)
            # seen from the left at most i edits come before, seen from the right at most TAU - i come after
            lo = max(0, start - i, start + shift - (TAU - i))
            hi = min(n - size, start + i, start + shift + (TAU - i))
            for at in range(lo, hi + 1):
                found.add((other, i, name[at : at + size]))
    return found


def keys_of(slug: str | None, url: str | None) -> list[tuple[str, str, str, str, str]]:
    """(year, kind, name, place, address) of a row; `address` is set, and nothing else but year and place, for a match by address."""
    own = key_of(slug)
    keys = [(*own, "")] if own else []
    hit = _URL.match(url or "")
    if not hit:
        return keys
    host = hit[1].lower().removeprefix("www.")
    parts = [p for p in hit[2].split("/") if p]
    while len(parts) > 1 and parts[-1].lower() in PAGES:
        parts.pop()
    for part in [*parts, host.split(".")[0]]:
        key = key_of(part)
        if key and len(part) > 4 and re.search(r"[a-z]", key[2]) and (not own or (own[0] == key[0] and (own[1] == key[1] or "" in (own[1], key[1])))):
            if (*key, "") not in keys:
                keys.append((*key, ""))
    years = ["20" + p[-2:] for p in parts if re.fullmatch(r"20[0-4]\d", p)]
    year = own[0] if own else years[0] if years else None
    if year and host and parts and not (years and years[0] != year):
        keys.append((year, "", "", own[3] if own else "", host + "/" + "/".join(parts).lower()))
    return keys


_KEY = "struct<year:string,kind:string,name:string,place:string,address:string,stored:array<string>,asked:array<string>>"


def keyed(df: DataFrame, row_id: str, slug: str, url: str) -> DataFrame:
    """(row_id, year, kind, name, place, address, stored, asked): the keys of each row with their segments and probes."""

    @F.pandas_udf(f"array<{_KEY}>")
    def _keyed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for slugs, urls in batches:
            out = []
            for slug, url in zip(slugs, urls, strict=True):
                row = []
                for year, kind, name, place, address in keys_of(slug, url):
                    if address:
                        stored = asked = ["@" + address]
                    else:
                        stored = [f"{kind}|{len(name)}|{i}|{text}" for i, _, text in segments(name)]
                        asked = [f"{kind}|{n}|{i}|{text}" for n, i, text in probes(name)]
                    row.append({"year": year, "kind": kind, "name": name, "place": place, "address": address, "stored": stored, "asked": asked})
                out.append(row)
            yield pd.Series(out)

    got = df.select(F.col(f"`{row_id}`").alias("row_id"), F.explode(_keyed(F.col(f"`{slug}`").cast("string"), F.col(f"`{url}`").cast("string"))).alias("k"))
    return got.select("row_id", "k.*")


#: Segments of one bucket that a first batch aims at; an index keeps the number of buckets that it began with.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 1_024
#: So many generations of one level are merged into one of the next: a row is rewritten log(batches) times.
FAN = 6
FILTER_BITS = 1 << 22
INDEX = T.StructType([*[T.StructField(n, T.StringType()) for n in ("segment", "name", "place", "batch")], T.StructField("root", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("gen", "year", "bucket")]])


class SegmentIndex:
    """The index of everything accepted so far; whoever opens its folder, in whatever session, finds what was appended before.

    The folder holds generations, each laid out by year and bucket of the
    segment, and a batch reads only the buckets of the years it probes.  Rows
    carry the label of their batch, which does not see them: a batch that is
    taken in again after a failure gets the same answers.  Answers of `matches`
    must be kept (written) before the next `append`, which may merge generations.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _gens(self) -> list[str]:
        """Generations as level-buckets-id, from the names of their folders."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n.removeprefix("gen=") for n in names if n.startswith("gen="))

    def _rows(self, gens: str = "*", years: str = "*") -> DataFrame:
        """What some generations hold of some years; only the folders named are listed."""
        try:
            return self.spark.read.schema(INDEX).option("basePath", self.folder).parquet(f"{self.folder}/gen={gens}/year={years}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], INDEX)

    def matches(self, keys: DataFrame, batch: str) -> DataFrame:
        """(row_id, root, known): the accepted edition that each row repeats, and which of its writings the index already holds for it."""
        gens = self._gens()
        if not gens:
            return self.spark.createDataFrame([], "row_id bigint, root bigint, known array<string>")
        asked = keys.select("row_id", "year", F.col("name").alias("q"), F.col("place").alias("q_place"), F.explode("asked").alias("segment"))
        asked = asked.withColumn("bucket", _bucket(int(gens[0].split("-")[1])))
        probed: dict[str, list[str]] = {}
        for year, bucket in asked.select("year", "bucket").distinct().collect():  # at most (years, 50) x (buckets, 1,024)
            probed.setdefault(year, []).append(bucket)
        inside = reduce(lambda a, b: a | b, [(F.col("year") == y) & F.col("bucket").isin(bs) for y, bs in probed.items()], F.lit(False))
        index = self._rows(years="{" + ",".join(sorted(probed)) + "}").where(inside).where(F.col("batch") != batch).select("segment", "name", "place", "root", "year", "bucket")
        index = _among(index, asked)
        found = asked.join(index, ["year", "bucket", "segment"])
        edits = F.levenshtein("q", "name", TAU)
        places = F.when((F.col("place") == "") | (F.col("q_place") == ""), TAU + 1).otherwise(F.levenshtein("place", "q_place", TAU))
        found = found.withColumns({"edits": edits, "place_edits": places}).where((F.col("edits") >= 0) & (F.col("place_edits") >= 0))
        # short names have less room for edits, and with a drifted place there is room for one only
        found = found.where((F.col("edits") <= F.length("name") / 4) & (F.col("place_edits").isin(0, TAU + 1) | (F.col("edits") <= 1)))
        held = F.when((F.col("q") == F.col("name")) & (F.col("q_place") == F.col("place")), _writing())
        best = found.groupBy("row_id", "root").agg(F.min(F.col("place_edits") + F.col("edits")).alias("cost"), F.collect_set(held).alias("known"))  # a row has a handful of writings
        ranked = best.groupBy("row_id").agg(
            F.min(F.struct("cost", "root", "known")).alias("m"),
            # without a place on one side, two editions that fit are no answer
            F.count_if(F.col("cost") > TAU).alias("open"), F.count_if(F.col("cost") <= TAU).alias("sure"),
        )
        return ranked.where((F.col("sure") > 0) | (F.col("open") == 1)).select("row_id", F.col("m.root").alias("root"), F.col("m.known").alias("known"))

    def append(self, keys: DataFrame, answers: DataFrame, batch: str) -> None:
        """Adds the segments of a batch's new writings, each under the first arrival of its edition; `answers` come from `matches`."""
        gens = self._gens()
        new = keys.join(answers.select("row_id", "root", "known"), "row_id", "left")
        new = new.select(F.explode("stored").alias("segment"), "name", "place", F.lit(batch).alias("batch"), F.coalesce("root", "row_id").alias("root"), "year", "known")
        new = new.where(~F.coalesce(F.array_contains("known", _writing()), F.lit(False))).drop("known")
        buckets = int(gens[0].split("-")[1]) if gens else min(MOST_BUCKETS, max(1, new.count() // BUCKET_ROWS))
        # of equal writings in one batch the first arrival stands for all
        new = new.groupBy("year", "segment", "name", "place", "batch").agg(F.min("root").alias("root"))
        gens.append(self._write(new, 0, buckets))
        level = 0
        while len(ripe := [g for g in gens if g.startswith(f"{level:02d}-")]) >= FAN:
            # a merge that breaks off leaves repeated rows, which change nothing
            rows = self._rows("{" + ",".join(ripe) + "}").dropDuplicates(["year", "segment", "name", "place", "batch", "root"])
            gens.append(self._write(rows, level + 1, buckets))
            for g in ripe:
                removed(self.spark, f"{self.folder}/gen={g}")
            level += 1

    def _write(self, rows: DataFrame, level: int, buckets: int) -> str:
        gen = f"{level:02d}-{buckets}-{uuid.uuid4().hex}"
        rows = rows.withColumn("bucket", _bucket(buckets)).select("segment", "name", "place", "batch", "root", "year", "bucket").repartition("year", "bucket").sortWithinPartitions("year", "bucket", "segment")
        rows.write.option("compression", "zstd").partitionBy("year", "bucket").parquet(f"{self.folder}/gen={gen}")
        return gen


def _among(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Index rows whose segment may be asked for, told by a bitmap of FILTER_BITS bits before anything of the index is shuffled.

    The bitmap is 512 KB whatever the batch; the more a batch asks for, the less
    it holds back, and it holds back nothing that is asked for.
    """
    at = F.pmod(F.xxhash64("segment"), F.lit(FILTER_BITS)) + 1
    bits = asked.select(at.alias("__at")).groupBy(F.bitmap_bucket_number("__at").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__at")).alias("__bits"))
    rows = index.withColumn("__at", at).withColumns({"__part": F.bitmap_bucket_number("__at"), "__pos": F.bitmap_bit_position("__at")})
    byte = F.conv(F.hex(F.substr("__bits", (F.floor(F.col("__pos") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return rows.join(F.broadcast(bits), "__part").where(F.getbit(byte, (F.col("__pos") % 8).cast("int")) == 1).drop("__at", "__part", "__pos", "__bits")


def _writing() -> Column:
    """One text per kind, name and place, or address, of an exploded row."""
    return F.when(F.col("segment").startswith("@"), F.col("segment")).otherwise(F.concat_ws("\u0001", F.substring_index("segment", "|", 1), "name", "place"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("segment"), F.lit(buckets)).cast("string")


def deduplicated(df: DataFrame, row_id: str, batch: str, slug: str, url: str, index: SegmentIndex | None = None) -> DataFrame:
    """(earlier_id, row_id): arrivals whose edition an earlier batch holds, batch after batch against the index.

    With an `index` of its own the caller keeps the history: rows of a later
    call are checked against all batches of earlier ones.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    index = index or SegmentIndex(spark, folder + "/index")
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
    rows = df.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), F.col(f"`{batch}`").alias("batch"), text(slug).alias("slug"), text(url).alias("url"))
    rows = rows.where(F.col("batch").isNotNull() & ((F.col("slug") != "") | (F.col("url") != "")))
    # rows of one batch with the same texts get one answer, however many they are
    groups = rows.groupBy("batch", "slug", "url").agg(F.min("row_id").alias("first"), F.count("*").alias("n"))
    groups.write.partitionBy("batch").parquet(folder + "/groups")  # a batch then reads its own rows only
    groups = spark.read.schema(T.StructType([*groups.select("slug", "url", "first", "n").schema, groups.schema["batch"]])).parquet(folder + "/groups")
    answer = "row_id bigint, root bigint, known array<string>"
    batches = sorted(r[0] for r in groups.select("batch").distinct().collect())
    for n in batches:  # one job per batch, as they come
        mine = groups.where(F.col("batch") == n).select("first", F.nullif(F.substring("slug", 2, 1 << 30), F.lit("")).alias("slug"), F.nullif(F.substring("url", 2, 1 << 30), F.lit("")).alias("url"))
        keys = keyed(mine, "first", "slug", "url").persist()  # one batch, read three times; a lost part is made again
        place = f"{folder}/found/batch={n}"
        index.matches(keys, str(n)).write.mode("overwrite").parquet(place)
        index.append(keys, spark.read.schema(answer).parquet(place), str(n))
        keys.unpersist()
    if not batches:
        return spark.createDataFrame([], "earlier_id bigint, row_id bigint")
    if index.folder.startswith(folder):
        removed(spark, index.folder)
    found = spark.read.schema(answer).option("recursiveFileLookup", "true").parquet(folder + "/found").select("row_id", "root")
    answered = groups.join(found, F.col("first") == F.col("row_id")).select("batch", "slug", "url", "n", F.col("root").alias("earlier_id"))
    return salted_join(rows, answered, ["batch", "slug", "url"], "n", spread=F.xxhash64("row_id")).select("earlier_id", "row_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Each arrival that repeats an edition, with the first arrival of it."""
    found = deduplicated(read(spark, d, "cfp_intake"), "arrival_id", "batch_no", "slug", "cfp_url")
    return found.select("earlier_id", F.col("row_id").alias("arrival_id"))


def p6_batches(spark: SparkSession, d: str) -> DataFrame:
    """Per batch: arrivals, and how many of them repeat accepted history."""
    rows = read(spark, d, "cfp_intake")
    found = deduplicated(rows, "arrival_id", "batch_no", "slug", "cfp_url").select(F.col("row_id").alias("arrival_id"), "earlier_id")
    return rows.join(found, "arrival_id", "left").groupBy("batch_no").agg(F.count("*").alias("n_arrivals"), F.count("earlier_id").alias("n_repeated"))


QUERIES = {"p6_found": p6_found, "p6_batches": p6_batches}
