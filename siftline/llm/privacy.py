"""Problem 9: personal information in free text, found and replaced by typed placeholders.

Bootstrapped contextual extraction.  Emails, telephone numbers and addresses of
strict form are entities by their form; persons named right before their own
email address seed the names, numbers after a word for an identity document seed
the identity numbers, international telephone numbers seed the looser ones.  The
words around seeds, and for numbers the order of their letters, digits and
separators, are lexical patterns.  Spark scores the graph of patterns and
instances in rounds: a pattern is as trustworthy as the share of known instances
among all it surrounds, an instance as the patterns that surround it; trusted
patterns bring in given names, family names and numbers that no seed showed.  A
last pass finds every occurrence of what was learned, in any case and order.

Defined results: null and empty texts have no span; offsets count code points of
the stored text; of overlapping finds the better one stays (a number right after
the word for its document, then email, address, phone, other identity numbers,
names) and among equals the longer one, then the one that starts first, and a
find that meets none of those that stay stays too; long texts are searched whole; repeated documents
get equal spans each.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.skew import checkpointed
from siftline.sources.tables import read

ROUNDS = 2
#: A pattern counts from this many distinct known instances and this share of all instances it surrounds.
LEAST_KNOWN, TRUST = 3, 0.75
#: Learned given names go to the executors whole up to this many; more are joined instead.
MAX_GIVEN = 200_000

S = r"(?:[ \t  ]|&nbsp;)+"
WORD = r"[^\W\d_]+(?:[’'][^\W\d_]+)?(?:-[^\W\d_]+)*"

# --- entities by form -----------------------------------------------------------------
_AT = r"(?:@|＠|&#64;|&#x40;|&commat;)"
_HIDDEN_AT = r"(?:\s?[(\[{<]\s?(?:at|ät|arroba|chez|arobase|@)\s?[)\]}>]\s?)"
_HIDDEN_DOT = r"(?:\s?[(\[{<]\s?(?:dot|punkt|punto|point|\.)\s?[)\]}>]\s?|\s(?:dot|punkt|punto|point)\s)"
_LABEL = r"[^\W_](?:[^\W_]|-(?=[^\W_]))*"
EMAIL = re.compile(
    rf"(?<![\w.+%-])[^\W_][\w.+%'-]*(?:{_AT}{_LABEL}(?:(?:\.|{_HIDDEN_DOT}){_LABEL})+|{_HIDDEN_AT}{_LABEL}(?:(?:\.|{_HIDDEN_DOT}){_LABEL})+|\s(?:at|arroba|ät|chez)\s{_LABEL}(?:\sdot\s|\spunkt\s|\spunto\s|\spoint\s){_LABEL}(?:(?:\.|{_HIDDEN_DOT}){_LABEL})*)(?![\w@])",
    re.I,
)
_SEP = r"(?:[  .\-/]|&nbsp;)"
_EXT = rf"(?:,?{_SEP}?(?:x|ext\.?|extension|durchwahl|dw\.?|poste|#){_SEP}?\d{{1,6}})?"
PHONE = re.compile(
    r"(?<![\w.#+/-])(?<!ISBN )(?:"
    rf"\(?(?:\+|00)\d{{1,3}}\)?(?:{_SEP}?\(?\d{{1,6}}\)?){{1,7}}"
    rf"|\(?0\d{{1,5}}\)?(?:{_SEP}?\d{{2,9}}){{1,5}}"
    rf"|(?:1{_SEP})?\(?[2-9]\d{{2}}\)?{_SEP}?{_SEP}?\d{{3}}{_SEP}\d{{4}}"
    rf"|[6-9]\d{{2}}(?:{_SEP}?\d{{2,3}}){{2,3}}"
    rf"){_EXT}(?![\w]|[.,:\-/]\d)"
)
_TOWN = rf"(?:(?:port|new|sankt|saint|san|st\.?|old|great|bad){S})?{WORD}"
_NO = r"\d{1,4}(?: ?[a-f](?![^\W\d_]))?"
_FLAT = rf"(?:(?:flat|apt\.?|apartment|unit|suite){S}\d+[a-z]?)"
_POST = r"(?:(?:[a-z]{1,2}-)?\d{4,6})"
_EN = rf"(?:{_FLAT},?{S})?{_NO}{S}(?:{WORD}{S}){{1,3}}?(?:street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|close|blvd\.?|boulevard|court|ct\.?|drive|dr\.?|way|row|place|square|hill|terrace|crescent|gardens|quay|walk|mews)(?:,{S}{_FLAT})?,{S}{_TOWN}(?:,{S}[a-z]{{2}}{S}\d{{4,6}}|,?{S}\d{{4,6}})?"
_DE = rf"(?:[^\W\d_]+(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer|steig|hof|markt|chaussee|pfad|stieg)|(?:hinter|am|an|zum|zur|im|in|auf|unter|vor|bei)(?:{S}[^\W\d_]+){{1,3}}){S}{_NO}(?:,{S}|{S}/{S})(?:{_POST}{S})?{_TOWN}"
_FR = rf"\d{{1,4}} ?(?:[a-f](?![^\W\d_]))?(?:{S}(?:bis|ter|quater))?,?{S}(?:rue|place|chemin|impasse|bd|boulevard|avenue|av\.|quai|allée|cours|passage|route|square|sentier|faubourg){S}(?:[^\s,\d<>|;]+{S}){{0,4}}?[^\s,\d<>|;]+,{S}(?:{_POST}{S})?{_TOWN}"
_ES = rf"(?:calle|c/|plaza|pza\.?|paseo|avenida|avda\.?|av\.|camino|ronda|travesía|carretera|callejón|cuesta|glorieta){S}(?:[^\s,\d<>|;]+{S}){{0,4}}?[^\s,\d<>|;]+,?{S}(?:n\.?º{S}?|nº{S}?|núm\.{S}?)?{_NO}(?:,{S}\d+\.?[ºª](?:{S}[a-z]\b)?)?,{S}(?:{_POST}{S})?{_TOWN}"
ADDRESS = re.compile(rf"(?<![\w-])(?:{_EN}|{_DE}|{_FR}|{_ES})(?![\w])", re.I)
ADDRESS_NUMBER_FIRST = re.compile(rf"(?<![\w-])(?:{_EN}|{_FR}|{_ES})(?![\w])", re.I)
#: What every address of the form street, number, town holds; without it the text is not searched for that form.
_NUMBER_THEN_TOWN = re.compile(rf"\d ?[a-f]?(?:,|{S}/){S}(?:[a-z]{{1,2}}-)?(?:\d{{4,6}}{S})?[^\W\d_]", re.I)
#: Words for identity documents in English, German, French and Spanish, as `key` writes them: they seed the identity numbers.
DOCUMENTS = frozenset(
    "passport ssn nino passeport pasaporte reisepass pass passnummer passnr ausweis ausweisnummer ausweisnr personalausweis personalausweisnummer dni nif nie nir steuernummer sozialversicherungsnummer".split()
    + ["social security", "national insurance", "identity card", "id card", "tax id", "tax form", "steuer id", "numero fiscal", "numero fiscale", "securite sociale", "seguridad social", "carte identite", "piece identite", "documento identidad"]
)
#: Words and signs that may stand between such a word and its number.
_LINKS = frozenset(": = # . no nr num number nummer numero n º is est es ist lautet card".split())
#: Words before a number that are searched for the word of a document.
REACH = 8
CODE = re.compile(r"(?<![\w#/@.-])(?:[A-Za-z]{1,3}[- ]?)?\d(?:[- .]?\d|[- ]?[A-Z](?![A-Za-z])){4,16}(?:-?[A-Za-z])?(?![\w@-])")
_LOWER = re.compile(r"(?<![\w@.+-])[^\W\d_]+(?![\w@.+-])")
_TOKEN = re.compile(rf"{WORD}|\d+|[^\s\w]")


def key(text: str) -> str:
    """Lower case without accents: one key for all writings of a name."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.casefold().replace("ø", "o").replace("ß", "ss"))
    return "".join(c for c in text if not unicodedata.combining(c))


def before(text: str, start: int, n: int) -> list[str]:
    """The last `n` words or signs before a place, whole however long they are."""
    reach = 16 * n
    while True:
        lo = max(0, start - reach)
        found = [m[0] for m in _TOKEN.finditer(text, lo, start)]
        if lo == 0 or len(found) > n:  # the first one may be cut by the window
            return found[-n:]
        reach *= 4


def context(text: str, start: int, end: int) -> tuple[str, str]:
    """(left, right): the two words or signs before a span and the one after it, digits all alike."""
    right = _TOKEN.search(text, end)
    return " ".join(re.sub(r"\d+", "9", key(t)) for t in before(text, start, 2)), re.sub(r"\d+", "9", key(right[0])) if right else ""


def after(text: str, end: int, n: int) -> list[str]:
    """The next `n` words or signs after a place."""
    return [m[0] for m in islice(_TOKEN.finditer(text, end), n)]


def documented(text: str, start: int, end: int) -> int:
    """2 when the word for an identity document stands right before a span, 1 when among the words around it, else 0."""

    def parts(tokens: list[str]) -> list[str]:
        return [w for t in tokens for w in key(t).split("-") if w and w not in ("’", "'", "d", "l", "de", "du", "la", "&", "nbsp", ";")]

    def has(words: list[str]) -> bool:
        return any(w in DOCUMENTS or " ".join(words[i : i + 2]) in DOCUMENTS for i, w in enumerate(words))

    words = parts(before(text, start, REACH))
    far = has(words) or has(parts(after(text, end, REACH)))
    while words and words[-1] in _LINKS:
        words.pop()
    return 2 if has(words[-1:]) or has(words[-2:]) and " ".join(words[-2:]) in DOCUMENTS else int(far)


def readings(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The spans that begin and end at a blank of a span and hold six digits: its first and last groups may belong to the words around it."""
    blanks = [i for i in range(start, end) if text[i] == " "]
    found = [(a, b) for a in (start, *[i + 1 for i in blanks]) for b in (*blanks, end) if b > a and sum(c.isdigit() for c in text[a:b]) >= 6]
    found = [(a, b) for a, b in found if not re.fullmatch(r"(?:[A-Za-z]{1,3} )?(?:19|20)\d\d-\d\d-\d\d", text[a:b])]  # dates
    return [(a, b) for a, b in found if not ((first := key(text[a:b].split(" ")[0])) in _LINKS or first in DOCUMENTS or first == "id")]


def shape(code: str) -> str:
    """The order of letters, digits and separators of a number."""
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", code))


def formed(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities known by their form, without overlaps."""
    taken: list[tuple[str, int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for _, x, y in taken)

    for m in EMAIL.finditer(text):
        a, b = m.span()
        if free(a, b):
            taken.append(("email", a, b))
    for m in (ADDRESS if _NUMBER_THEN_TOWN.search(text) else ADDRESS_NUMBER_FIRST).finditer(text):
        if free(*m.span()):
            taken.append(("address", *m.span()))
    for m in PHONE.finditer(text):
        a, b = m.span()
        body = re.sub(_EXT + "$", "", m[0]) if "x" in m[0].lower() else m[0]
        n = sum(c.isdigit() for c in body)
        if not 9 <= n <= 15 or not free(a, b):
            continue
        if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", m[0]) or re.match(r"(?:19|20)\d\d-\d\d-\d\d", m[0]):
            continue
        while text[b - 1] in ") ":
            b -= 1
        taken.append(("phone", a, b))
    return taken


_UPPER = "A-ZÀ-ÖØ-ÞĀ-ŽΑ-ΩА-Я"
_PAIR = re.compile(rf"(?<![\w@.-])([{_UPPER}][^\W\d_]+){S}(?:[^\W\d_]\.?{S})?([{_UPPER}][^\W\d_]*(?:[’'][^\W\d_]+)?(?:-[^\W\d_]+)*)(?![\w@])(?:{S}[<(]?([\w.+%-]+)@)?")


def persons(text: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, given, family, seed): capitalised pairs that may be a person; a seed stands before an email that spells it."""
    at = 0
    while m := _PAIR.search(text, at):
        at = m.end(1)
        a, b = m[1], m[2]
        if len(b) > 2:
            local = key(m[3] or "").replace("-", "")
            parts = key(b).replace("-", "")
            yield m.start(1), m.end(2), key(a), key(b), bool(m[3]) and parts in local and len(parts) > 3


_FOUND = "doc_id bigint, kind string, s int, e int, a string, b string, left string, right string, seed boolean, n bigint"


def scanned(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """First pass: entities by form, candidate pairs and codes with their contexts, and counts of words in lower case."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, words = [], Counter()
            for i, t in zip(batch["i"], batch["t"], strict=True):
                if not isinstance(t, str) or not t:
                    continue
                forms = formed(t)
                for kind, s, e in forms:
                    left, right = context(t, s, e) if kind == "phone" else (None, None)
                    out.append((i, kind, s, e, None, None, left, right, t[s] in "+(" or t.startswith("00", s), None))
                for s, e, a, b, seed in persons(t):
                    left, right = context(t, s, e)
                    out.append((i, "pair", s, e, a, b, left, right, seed, None))
                for m in CODE.finditer(t):
                    for s, e in readings(t, *m.span()):
                        hits, near = [k for k, x, y in forms if s < y and x < e], documented(t, s, e)
                        # a number that reads as a telephone number too is one unless its document stands right before it
                        if not hits or (hits == ["phone"] and near == 2):
                            left, right = context(t, s, e)
                            out.append((i, "code", s, e, re.sub(r"[\W_]", "", t[s:e]).upper(), shape(t[s:e]), left, right, near > 0, near))
                words.update(w for w in _LOWER.findall(t) if w.islower())
            out += [(None, "word", None, None, None, key(w), None, None, None, n) for w, n in words.items()]
            got = pd.DataFrame(out, columns=["doc_id", "kind", "s", "e", "a", "b", "left", "right", "seed", "n"])
            for c, kind in (("doc_id", "Int64"), ("s", "Int32"), ("e", "Int32"), ("n", "Int64"), ("seed", "boolean")):
                got[c] = got[c].astype(kind)
            yield got

    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t")).mapInPandas(rows, _FOUND)


def _sides(*more: tuple[str, str]) -> Column:
    """The two patterns around an instance: the two words before it, and the one before with the one after; and `more` (side, column)."""
    around = F.concat_ws("\u0001", F.element_at(F.split("left", " "), -1), "right")
    return F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("pattern")), F.struct(F.lit("r").alias("side"), around.alias("pattern")), *[F.struct(F.lit(s).alias("side"), F.col(c).alias("pattern")) for s, c in more]))


def trusted_patterns(instances: DataFrame, *more: tuple[str, str]) -> DataFrame:
    """(side, pattern, trust) from (instance, left, right, known): the share of known ones among the instances a pattern surrounds."""
    sides = instances.select("instance", "known", _sides(*more).alias("x"))
    once = sides.select("instance", "known", "x.side", "x.pattern").where(~F.col("pattern").isin("", "\u0001")).distinct()
    scored = once.groupBy("side", "pattern").agg(F.count_if("known").alias("k"), F.count("*").alias("n"))
    return scored.where((F.col("k") >= LEAST_KNOWN) & (F.col("k") >= TRUST * F.col("n"))).select("side", "pattern", (F.col("k") / (F.col("n") + 1)).alias("trust"))


def trusted_instances(instances: DataFrame, patterns: DataFrame, *more: tuple[str, str]) -> DataFrame:
    """(instance, trust): 1 less the chance that all patterns around an instance err."""
    sides = instances.select("instance", _sides(*more).alias("x"))
    once = sides.select("instance", "x.side", "x.pattern").distinct().join(patterns, ["side", "pattern"])
    return once.groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust") + 1e-6)))).alias("trust"))


def learned_numbers(found: DataFrame) -> DataFrame:
    """(doc_id, kind, s, e, rank): identity numbers, and telephone numbers of looser form, learned in rounds from the seeds.

    Instances are the numbers themselves, so that one which mostly stands near
    the word for a document is known wherever it stands; each occurrence is
    judged by its own patterns.
    """
    form = ("s", "b")
    codes = found.where(F.col("kind") == "code").select("doc_id", "s", "e", F.col("a").alias("instance"), "b", "left", "right", "seed", F.col("n").alias("near"))
    # a number that stands everywhere also stands near the word for a document now and then
    known = codes.groupBy("instance").agg(F.avg(F.col("seed").cast("int")).alias("seeds")).where(F.col("seeds") >= 0.5).select("instance")
    for _ in range(ROUNDS):
        now = codes.join(known.withColumn("known", F.lit(True)), "instance", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        patterns = checkpointed(trusted_patterns(now, form))
        known = checkpointed(known.union(trusted_instances(codes, patterns, form).where(F.col("trust") >= TRUST).select("instance")).distinct())
    each = codes.withColumn("instance", F.concat_ws("\u0001", "doc_id", "s", "e"))
    sure = trusted_instances(each, patterns, form).where(F.col("trust") >= TRUST).select("instance", F.lit(True).alias("sure"))
    shapes = patterns.where(F.col("side") == "s").select(F.col("pattern").alias("b"), F.col("trust").alias("form_trust"))
    judged = each.join(sure, "instance", "left").join(shapes, "b", "left")
    judged = checkpointed(judged.select("doc_id", "s", "e", "instance", "b", "left", "right", "near", F.coalesce("form_trust", F.lit(0.0)).alias("form_trust"), (F.coalesce("sure", F.lit(False)) | (F.col("near") == 2)).alias("is_id")))
    # of two readings of one number the one whose form is better known comes first
    ids = judged.where("is_id").select("doc_id", F.lit("id_number").alias("kind"), "s", "e", (F.when(F.col("near") == 2, -1.0).otherwise(1.0) - F.col("form_trust") / 2).alias("rank"))
    # telephone numbers in national writings: digits alone under the words that stand before international ones
    phones = found.where(F.col("kind") == "phone").select(F.concat_ws("\u0001", "doc_id", "s", "e").alias("instance"), "left", "right", F.col("seed").alias("known"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"))
    loose = judged.where(~F.col("is_id") & (F.col("near") == 0) & ~F.col("b").contains("a")).select("instance", "left", "right", F.lit(False).alias("known"), "doc_id", "s", "e")
    numbers = phones.unionByName(loose)
    said = trusted_patterns(numbers).where(F.col("side") == "l").select(F.col("pattern").alias("left"))
    more = loose.join(said, "left", "left_semi").select("doc_id", F.lit("phone").alias("kind"), "s", "e", F.lit(1.0).alias("rank"))
    return ids.unionByName(more)


def learned_names(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(given, family): name words with what speaks for them, learned in rounds from the seeds."""
    pairs = found.where(F.col("kind") == "pair").select("a", "b", "left", "right", "seed")
    words = found.where(F.col("kind") == "word").groupBy("b").agg(F.sum("n").alias("low"))
    use = pairs.select(F.explode(F.array("a", "b")).alias("b")).groupBy("b").agg(F.count("*").alias("high"))
    # words that are mostly written small are no names
    common = checkpointed(words.join(use, "b").where(F.col("low") > F.col("high")).select(F.col("b").alias("w")))
    given = checkpointed(pairs.where("seed").select(F.col("a").alias("w")).distinct())
    family = checkpointed(pairs.where("seed").select(F.col("b").alias("w")).distinct())
    pairs = pairs.join(common.select(F.col("w").alias("b")), "b", "left_anti")
    for _ in range(ROUNDS):
        g, f = given.select(F.col("w").alias("a"), F.lit(True).alias("in_g")), family.select(F.col("w").alias("b"), F.lit(True).alias("in_f"))
        now = pairs.join(g, "a", "left").join(f, "b", "left")
        now = checkpointed(now.select(F.concat_ws("\u0001", "a", "b").alias("instance"), "a", "b", "left", "right", (F.coalesce("in_g", F.lit(False)) & F.coalesce("in_f", F.lit(False))).alias("known"), (F.coalesce("in_g", F.lit(False)) | F.coalesce("in_f", F.lit(False))).alias("half")))
        sure = trusted_instances(now, trusted_patterns(now)).where(F.col("trust") >= TRUST)
        # one half known, the other told by the patterns around it
        new = checkpointed(now.where("half").select("instance", "a", "b").distinct().join(sure, "instance", "left_semi"))
        given = checkpointed(given.union(new.select("a")).distinct())
        family = checkpointed(family.union(new.select("b")).distinct())
    return given.join(common, "w", "left_anti"), family.join(common, "w", "left_anti")


def named(docs: DataFrame, doc_id: str, text: str, given: DataFrame, family: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, s, e): every occurrence of a given name or initial with a family name, in any case and either order."""
    few = [r[0] for r in given.limit(MAX_GIVEN + 1).collect()]
    lexicon = docs.sparkSession.sparkContext.broadcast(frozenset(few)) if len(few) <= MAX_GIVEN else None
    tokens = re.compile(WORD)
    gap, comma, middle = re.compile(S), re.compile(rf",{S}"), re.compile(rf"{S}[^\W\d_](?:\.{S}?|{S})")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lexicon.value if lexicon else None
        for batch in batches:
            out = []
            for i, t in zip(batch["i"], batch["t"], strict=True):
                if not isinstance(t, str) or not t:
                    continue
                ws = [m for m in tokens.finditer(t) if not ((m.start() and t[m.start() - 1] in "@._+%") or (m.end() < len(t) - 1 and t[m.end()] in "@_+%" or t[m.end() : m.end() + 1] == "." and t[m.end() + 1 : m.end() + 2].isalnum() and m.end() - m.start() > 1))]
                for j, m in enumerate(ws):
                    g = key(m[0])
                    nxt = ws[j + 1] if j + 1 < len(ws) else None
                    after = ws[j + 2] if j + 2 < len(ws) else None
                    if len(g) > 1 and (known is None or g in known):
                        if nxt and len(nxt[0]) > 1 and gap.fullmatch(t, m.end(), nxt.start()):
                            out.append((i, m.start(), nxt.end(), "gf", g, key(nxt[0]), nxt[0][0].isupper()))
                        elif nxt and len(nxt[0]) == 1 and after and re.fullmatch(rf"{S}{re.escape(nxt[0])}\.?{S}", t[m.end() : after.start()]):
                            out.append((i, m.start(), after.end(), "gf", g, key(after[0]), after[0][0].isupper()))
                        if j and comma.fullmatch(t, ws[j - 1].end(), m.start()) and len(ws[j - 1][0]) > 1:
                            e = m.end()
                            if nxt and len(nxt[0]) == 1 and re.fullmatch(rf"{S}", t[m.end() : nxt.start()]) and t[nxt.end() : nxt.end() + 1] == ".":
                                e = nxt.end() + 1
                            out.append((i, ws[j - 1].start(), e, "fg", g, key(ws[j - 1][0]), ws[j - 1][0][0].isupper()))
                        elif j and gap.fullmatch(t, ws[j - 1].end(), m.start()) and len(ws[j - 1][0]) > 2:
                            out.append((i, ws[j - 1].start(), m.end(), "f g", g, key(ws[j - 1][0]), ws[j - 1][0][0].isupper()))
                    elif len(m[0]) == 1 and m[0].isalpha() and nxt and len(nxt[0]) > 2 and re.fullmatch(rf"\.{S}?|{S}", t[m.end() : nxt.start()]):
                        first = m
                        if m[0].isupper() or t[m.end()] == ".":
                            out.append((i, first.start(), nxt.end(), "if", None, key(nxt[0]), nxt[0][0].isupper()))
                    # 'Family, I.' has no given name: whether the word is one doesn't matter
                    if len(m[0]) > 2 and nxt and len(nxt[0]) == 1 and re.fullmatch(rf",{S}", t[m.end() : nxt.start()]) and t[nxt.end() : nxt.end() + 1] == ".":
                        out.append((i, m.start(), nxt.end() + 1, "fi", None, key(m[0]), m[0][0].isupper()))
            got = pd.DataFrame(out, columns=["doc_id", "s", "e", "form", "g", "f", "upper"])
            for c, kind in (("doc_id", "Int64"), ("s", "Int32"), ("e", "Int32")):
                got[c] = got[c].astype(kind)
            yield got

    spans = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t")).mapInPandas(rows, "doc_id bigint, s int, e int, form string, g string, f string, upper boolean")
    if lexicon is None:
        spans = spans.where(F.col("g").isNull()).unionByName(spans.join(given.select(F.col("w").alias("g")), "g", "left_semi"))
    spans = checkpointed(spans)  # read three times below
    parts = spans.withColumn("part", F.explode(F.array_union(F.array("f"), F.split("f", "-"))))
    surnames = family.select(F.col("w").alias("part"), F.lit(True).alias("hit"))
    use = spans.where(F.col("form") == "gf").groupBy("f").agg(F.count("*").alias("uses"))
    low = found.where(F.col("kind") == "word").groupBy(F.col("b").alias("f")).agg(F.sum("n").alias("low"))
    rare = use.join(low, "f", "left").select("f", (F.coalesce("low", F.lit(0)) <= F.col("uses")).alias("rare"))
    judged = parts.join(surnames, "part", "left").groupBy("doc_id", "s", "e", "form", "f", "upper").agg(F.max(F.coalesce("hit", F.lit(False))).alias("family"))
    judged = judged.join(rare, "f", "left")
    ok = F.col("family") | (F.col("form").isin("gf") & F.col("upper") & F.coalesce("rare", F.lit(False)))
    # without a comma the reversed order is believed only when no name goes the usual way from the same words
    return judged.where(ok).select("doc_id", "s", "e", F.when(F.col("form") == "gf", 0).when(F.col("form") == "if", 2).when(F.col("form") == "f g", 3).otherwise(1).alias("weight"))


def personal(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, pii_type, span_start, span_end): every occurrence, without overlaps."""
    found = checkpointed(scanned(docs, doc_id, text))
    given, family = learned_names(found)
    given, family = checkpointed(given), checkpointed(family)
    names = named(docs, doc_id, text, given, family, found).select("doc_id", F.lit("name").alias("kind"), "s", "e", (F.col("weight") + 10.0).alias("rank"))
    forms = found.where(F.col("kind").isin("email", "phone", "address")).select("doc_id", "kind", "s", "e", F.lit(0.0).alias("rank"))
    spans = forms.unionByName(learned_numbers(found)).unionByName(names)
    return without_overlaps(spans)


def without_overlaps(spans: DataFrame) -> DataFrame:
    """(doc_id, pii_type, span_start, span_end) from (doc_id, kind, s, e, rank): the best span first, each that meets none taken before."""

    @F.pandas_udf("array<struct<pii_type:string,span_start:int,span_end:int>>")
    def taken(batch: pd.Series) -> pd.Series:
        out = []
        for marks in batch:
            starts, ends, kept = [], [], []
            for _, _, s, e, kind in sorted((m["rank"], m["s"] - m["e"], m["s"], m["e"], m["kind"]) for m in marks):
                at = bisect.bisect_left(starts, e)  # spans taken are disjoint: only the last one before this end can meet it
                if at == 0 or ends[at - 1] <= s:
                    starts.insert(at, s)
                    ends.insert(at, e)
                    kept.append({"pii_type": kind, "span_start": s, "span_end": e})
            out.append(kept)
        return pd.Series(out)

    # the spans of one document, bounded by its text
    docs = spans.groupBy("doc_id").agg(F.collect_set(F.struct("rank", "s", "e", "kind")).alias("marks"))
    return docs.select("doc_id", F.explode(taken("marks")).alias("x")).select("doc_id", "x.*")


def redacted(docs: DataFrame, doc_id: str, text: str, spans: DataFrame) -> DataFrame:
    """The documents with each span replaced by its type in brackets; everything else is kept."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for t, ms in zip(texts, marks, strict=True):
            if isinstance(t, str) and ms is not None:
                for m in sorted(ms, key=lambda m: -m["span_start"]):
                    t = t[: m["span_start"]] + f"[{m['pii_type'].upper()}]" + t[m["span_end"] :]
            out.append(t)
        return pd.Series(out, dtype=object)

    marks = spans.groupBy(F.col("doc_id").alias("__i")).agg(F.collect_list(F.struct("pii_type", "span_start", "span_end")).alias("__m"))
    joined = docs.join(marks, F.col(f"`{doc_id}`") == F.col("__i"), "left")
    return joined.withColumn(text, mask(F.col(f"`{text}`"), F.col("__m"))).drop("__i", "__m")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Every personal datum in documents.text."""
    return personal(read(spark, d, "documents"), "doc_id", "text")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    return redacted(docs, "doc_id", "text", personal(docs, "doc_id", "text"))


QUERIES = {"p9_found": p9_found, "p9_redacted": p9_redacted}
