"""Problem 5: free-typed values mapped to the entry of a reference list they mean.

A multi-pattern automaton over all names, aliases and countries of the list finds
every mention inside a value; the longest non-overlapping mentions win.  A
country, its code or a region code beside a mention settles names that several
entries share, and speaks against an entry of another country.  Values without
a mention go to token-set similarity: their parts are compared with the names as
a whole and word by word, in any order and among other words, where a word may be
a few edits off.  Small words of names (port, new) may be written short; which
words those are is taken from the list.

The list travels to the executors whole: it is a reference list of a documented
size, at most MAX_ENTRIES, and a longer one is refused rather than cut.

Defined results: null, blank and placeholder values mean nothing; a value that
fits two entries means none (`status` says ``ambiguous``); ties in similarity
are ambiguous; an empty list matches nothing; long texts are searched whole for
mentions; repeated rows get equal answers.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.sources.tables import read

#: Longest list; its near-writing tables then take at most a few hundred MB in a worker, as arrays of numbers.
MAX_ENTRIES = 50_000
_LETTERS = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ł": "l", "ð": "d", "þ": "th", "ı": "i"})
#: Words of values that name no place.
NOWHERE = frozenset("several cities ship various tba tbd tbc unknown announced none null".split())
#: A word of this many letters beside a longer one (port, new, saint) may be written short.
SMALL = range(3, 6)
#: Answers a worker remembers for each kind of look-up; parts of values repeat far more than whole values.
ANSWERS = 50_000
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """Lower case without accents, words parted by one blank."""
    if text.isascii():  # nothing to compose or to take apart
        return " ".join(_WORD.findall(text.lower()))
    text = unicodedata.normalize("NFKD", text.casefold().translate(_LETTERS)).translate(_LETTERS)
    text = "".join(c for c in text if not unicodedata.combining(c))
    return " ".join(_WORD.findall(text))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or most + 1 when it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def deletions(text: str, most: int) -> set[str]:
    """The text with up to `most` letters left out: texts within that many edits share one of these."""
    out = level = {text}
    for _ in range(most):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        out = out | level
    return out


def allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 7 else 2


def writings(name: str) -> list[str]:
    """A folded name, and the short writings of names with a small word inside: without it, and by initials from there on."""
    words = name.split()
    out = [name] if name else []
    if len(words) == 3 and len(words[1]) <= 3 < len(words[0]):
        out += [f"{words[0]} {words[2]}", f"{words[0]} {words[1][0]} {words[2][0]}"]
    return out


def shortened(word: str) -> set[str]:
    """Short writings of a word: its first letter and at most two of the others in their order."""
    rest = word[1:]
    return {word[0]} | {word[0] + x for x in rest} | {word[0] + rest[i] + x for i in range(len(rest)) for x in rest[i + 1 :]}


class _Near:
    """Texts by what is left of them when letters go: arrays of hashes and of positions, no sets of strings."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.longest = max(map(len, texts), default=0)
        pairs = [(hash(t), i) for i, text in enumerate(texts) for t in deletions(text, allowed(len(text)))]
        keys = np.fromiter((k for k, _ in pairs), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], np.fromiter((i for _, i in pairs), dtype=np.int32, count=len(pairs))[order]
        self.known = lru_cache(ANSWERS)(self._found)

    def find(self, text: str) -> list[tuple[int, str]]:
        """(edits, text) of all texts within the edits that both lengths allow."""
        if len(text) > self.longest + allowed(len(text)) or not len(self.keys):  # too long for any
            return []
        return self.known(text)

    def _found(self, text: str) -> list[tuple[int, str]]:
        most = allowed(len(text))
        probes = np.fromiter((hash(t) for t in deletions(text, most)), dtype=np.int64)
        lo, hi = np.searchsorted(self.keys, probes, "left"), np.searchsorted(self.keys, probes, "right")
        near = {self.texts[i] for a, b in zip(lo, hi, strict=True) if b > a for i in self.at[a:b]}
        found = ((edits(text, n, min(most, allowed(len(n)))), n) for n in near)
        return [(d, n) for d, n in found if d <= min(most, allowed(len(n)))]


class Gazetteer:
    """The list, its automaton and its near-writing tables; `entries` are (id, name, alias or None, region or None, country, code)."""

    def __init__(self, entries: list[tuple]):
        import ahocorasick

        if len(entries) > MAX_ENTRIES:
            raise ValueError(f"a reference list of at most {MAX_ENTRIES} entries can be matched, not one of {len(entries)}")
        self.entry = {e[0]: e for e in entries}
        self.names: dict[str, set] = {}
        self.lands: dict[str, str] = {}
        self.codes: dict[str, str] = {}
        self.known_lands = lru_cache(ANSWERS)(self._fuzzy_lands)
        self.regions: dict[str, set] = {}
        for i, name, alias, region, country, code in entries:
            for n in (name, alias):
                for w in writings(folded(n)) if n else ():
                    self.names.setdefault(w, set()).add(i)
            if country:
                self.lands[folded(country)] = country
            if code:
                self.codes[code.lower()] = country
            if region:
                self.regions.setdefault(region.lower(), set()).add(country)
        self.longest_land = max(map(len, self.lands), default=0)
        self.automaton = ahocorasick.Automaton()
        for n in {*self.names, *self.lands}:
            self.automaton.add_word(f" {n} ", n)
        if self.names or self.lands:
            self.automaton.make_automaton()
        self.wholes: dict[str, set[str]] = {}
        self.holding: dict[str, set[str]] = {}
        for n in self.names:
            self.wholes.setdefault(n.replace(" ", ""), set()).add(n)
            for w in n.split():
                self.holding.setdefault(w, set()).add(n)
        self.near_wholes, self.near_words = _Near(sorted(self.wholes)), _Near(sorted(self.holding))
        small = {w for n in self.names for w in n.split() if len(w) in SMALL and max(map(len, n.split())) > len(w)}
        self.short: dict[str, list[str]] = {}
        for w in sorted(small):
            for x in shortened(w) - {w}:
                self.short.setdefault(x, []).append(w)

    def mentions(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, name) of the longest mentions that don't overlap, left to right among equals."""
        if not (self.names or self.lands):
            return []
        padded, found = f" {text} ", []
        for end, n in self.automaton.iter(padded):
            found.append((end - len(n) - 1, end - 1, n))
        found.sort(key=lambda m: (m[0] - m[1], m[0]))
        kept: list[tuple[int, int, str]] = []
        for a, b, n in found:
            if all(b <= x or a >= y for x, y, _ in kept):
                kept.append((a, b, n))
        return sorted(kept)

    def near_names(self, part: str) -> list[tuple[int, str]]:
        """(edits, name) of the names that a text may be a misspelling of, by token-set similarity."""
        words = part.split()
        out = {}
        # as it stands, and with a short writing of a common word written out
        for text in [words, *[[*words[:i], x, *words[i + 1 :]] for i, w in enumerate(words) for x in self.short.get(w, ())]]:
            for d, whole in self.near_wholes.find("".join(text)):
                for n in self.wholes[whole]:
                    if self._token_set(text, n.split()):
                        out[n] = min(d, out.get(n, d))
        return sorted((d, n) for n, d in out.items()) or self._by_words(words)

    def _by_words(self, words: list[str]) -> list[tuple[int, str]]:
        """(edits, name) of the names all of whose words are among the words, in any order and with others between; those of most words only."""
        close: dict[str, list[tuple[int, str]]] = {}
        for w in dict.fromkeys(words):
            if w in NOWHERE:
                continue
            for d, x in self.near_words.find(w):
                close.setdefault(x, []).append((d, w))
            for x in self.short.get(w, ()):
                close.setdefault(x, []).append((0, w))
        count, out = Counter(words), []

        def least(left: list[str]) -> int | None:
            if not left:
                return 0
            costs = []
            for d, w in close[left[0]]:
                if count[w]:
                    count[w] -= 1
                    rest = least(left[1:])
                    count[w] += 1
                    costs += [] if rest is None else [d + rest]
            return min(costs, default=None)

        for n in set().union(*(self.holding[x] for x in close)):
            own = n.split()
            if all(x in close for x in own) and (d := least(own)) is not None:
                out.append((len(own), d, n))
        most = max((k for k, _, _ in out), default=0)
        return sorted((d, n) for k, d, n in out if k == most)

    @staticmethod
    def _token_set(a: list[str], b: list[str]) -> bool:
        """Each word of one side has a counterpart on the other, or the words only differ in where they part."""
        if len(a) != len(b):
            return "".join(a) == "".join(b) or edits("".join(a), "".join(b), 1) <= 1
        return all(min(edits(x, y, 2) for y in b) <= max(1, allowed(len(x))) for x in a)

    @staticmethod
    def _words(text: str) -> list[str]:
        return [w for w in folded(text).split() if not w.isdigit()]

    def fuzzy_lands(self, words: list[str]) -> dict[str, int]:
        """Countries that the words may be a misspelling of, with the edits."""
        text = "".join(words)
        if len(text) > self.longest_land + allowed(len(text)):  # too long for any
            return {}
        return self.known_lands(text)

    def _fuzzy_lands(self, text: str) -> dict[str, int]:
        found = {c: edits(text, n.replace(" ", ""), allowed(len(text))) for n, c in self.lands.items()}
        return {c: d for c, d in found.items() if d <= allowed(len(text))}

    def resolve(self, value: str | None) -> tuple[int | None, str]:
        """(id, how): how is ``mention``, ``similar``, ``ambiguous``, ``country`` or ``none``."""
        if not value or not value.strip():
            return None, "none"
        whole = folded(value)
        kept = self.mentions(whole)
        places = {n for _, _, n in kept if n in self.names}
        lands = {self.lands[n] for _, _, n in kept if n in self.lands and n not in places}
        parts = [p for p in (self._words(x) for x in re.split(r"[,/|()–—:+&;\n]|\s-\s|(?<=^[A-Z]{2})-", value)) if p]
        loose = [*parts, self._words(value)] if len(parts) > 1 else parts
        # codes count when written as codes: two capitals, or alone in their part
        for w in re.findall(r"\b[A-Z]{2}\b", value):
            if w.lower() in self.codes:
                lands.add(self.codes[w.lower()])
        regions = {w for w in re.findall(r"\b[A-Z]{2}\b", value) if w.lower() in self.regions and w.lower() not in self.codes}
        how = "mention"
        candidates: list[set] = [self.names[n] for n in places]
        if not candidates:
            how = "similar"
            named: dict[str, int] = {}
            for p in loose:
                if p is loose[-1] and len(loose) > len(parts) and named:
                    continue  # the whole value, where none of its parts is a name
                core = [w for w in p if w not in self.codes and w.upper() not in {r.upper() for r in regions}]
                for words in ([p, core] if core != p else [p]):
                    if not words:
                        continue
                    got, land = self.near_names(" ".join(words)), self.fuzzy_lands(words)
                    if land and (not got or min(land.values()) <= got[0][0]):
                        lands |= set(land)
                        break
                    best = [n for d, n in got if d == got[0][0]]
                    for n in best:
                        named[n] = min(named.get(n, 9), got[0][0])
                    if got:
                        break
            if named:
                least = min(named.values())
                candidates = [set().union(*(self.names[n] for n, d in named.items() if d == least))]
        else:
            for p in parts:
                lands |= set(self.fuzzy_lands(p))
        if not candidates:
            return None, "country" if lands else "none"
        picked = set()
        for ids in candidates:
            fit = {i for i in ids if not lands or self.entry[i][4] in lands}
            if len(fit) > 1 and regions:
                fit = {i for i in fit if self.entry[i][3] in regions} or fit
            picked |= fit
        if len(picked) == 1:
            return next(iter(picked)), how
        return None, "ambiguous" if picked else "none"


_BUILT: dict[tuple, Gazetteer] = {}


def _gazetteer(entries: tuple) -> Gazetteer:
    """The gazetteer of a list, built once per worker."""
    if entries not in _BUILT:
        _BUILT.clear()
        _BUILT[entries] = Gazetteer(list(entries))
    return _BUILT[entries]


def entries_of(cities: DataFrame) -> tuple:
    """The reference list as plain tuples on the driver; one row more than allowed is enough to refuse it."""
    rows = cities.select("city_id", "city", "local_name", "region", "country", "country_code").limit(MAX_ENTRIES + 1).collect()
    return tuple(sorted(map(tuple, rows)))


def mapped(df: DataFrame, value: str, cities: DataFrame, out: str = "city_id", how: str = "status") -> DataFrame:
    """Adds `out`, the entry that `value` means, and `how` it was found; no shuffle, hot values are answered from a cache."""
    shared = df.sparkSession.sparkContext.broadcast(entries_of(cities))  # bounded by MAX_ENTRIES

    @F.pandas_udf("struct<id:int,how:string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        gazetteer = _gazetteer(shared.value)
        memo: dict = {}
        for batch in batches:
            got = []
            for v in batch:
                v = v if isinstance(v, str) else None
                hit = memo.get(v)
                if hit is None:
                    hit = gazetteer.resolve(v)
                    if len(memo) < 200_000 and (v is None or len(v) < 500):
                        memo[v] = hit
                got.append(hit)
            yield pd.DataFrame({"id": pd.array([g[0] for g in got], dtype="Int32"), "how": [g[1] for g in got]})

    find = find.asNondeterministic()  # a filter on the result must not run it twice
    k = "__place"
    while k in df.columns:
        k += "_"
    df = df.withColumn(k, find(F.col(f"`{value}`")))
    return df.withColumns({out: F.col(k + ".id"), how: F.col(k + ".how")}).drop(k)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """State rows whose city means one entry of the list."""
    rows = read(spark, d, "cfp_state").select("ord", "city")
    return mapped(rows, "city", read(spark, d, "canonical_cities")).where(F.col("city_id").isNotNull()).select("ord", "city_id")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The report of values that mean no entry, with why and how often."""
    rows = mapped(read(spark, d, "cfp_state").select("city"), "city", read(spark, d, "canonical_cities"))
    return rows.where(F.col("city_id").isNull()).groupBy("city", "status").agg(F.count("*").alias("n_rows"))


QUERIES = {"p5_found": p5_found, "p5_unmatched": p5_unmatched}
