"""Similarity join of person names: every pair of names that score `least` or more, without comparing all pairs.

The score has tiers: 100 the same words or letters, 95 one the beginning of the
other or its initials, 90 one within the other, else the token-set ratio. A name
sends keys for each way in which another can reach the bar, and each kind of key
is met by almost nothing but what reaches it, so that a word of a third of all names makes
no pairs of its own:

- the set of its words, and its letters in a row (equality);
- its words as a beginning, against all beginnings of the other;
- its initials with its two longest other words, against beginnings of initials;
- its letters in a row, against all runs of letters of the other;
- the words left when a small part is dropped, against all sets of words of the other (token-set ratio of what is shared);
- for each set of words that may be shared, what remains of the name: short remains by the
  subsequences that are left when as many letters are dropped as the bar allows, long
  ones by segments, one of which stays whole. Remains that both hold one of the few most
  frequent words do not meet, as that word is then among the shared.

Names are joined as distinct lists of words; a name of more than MOST_WORDS words
is no person's and is in no pair. Null and blank names are in none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import compare

LEAST = 85.0
MOST_WORDS = 8
#: Remains of so many letters at most go by subsequences.
SHORT = 16
#: So many of the most frequent words at most are known to the keys, if at least HOT names have them.
KNOWN, HOT = 16, 20


# ------------------------------------------------------------------------ score


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def token_set_ratio(u: list[str], v: list[str]) -> float:
    """0 to 100: the best of the shared words with the rest of either side, by inserted and deleted letters."""
    a, b = " ".join(sorted(set(u) - set(v))), " ".join(sorted(set(v) - set(u)))
    shared = len(" ".join(set(u) & set(v)))
    if shared and (not a or not b):
        return 100.0
    gap = 1 if shared else 0
    total = 2 * (shared + gap) + len(a) + len(b)
    found = [1 - (len(a) + len(b) - 2 * common_letters(a, b)) / total]
    if shared:
        found += [1 - (gap + len(x)) / (2 * shared + gap + len(x)) for x in (a, b)]
    return 100 * max(found)


def score(u: list[str], v: list[str]) -> float:
    """Of two lists of distinct words, 0 to 100."""
    if not u or not v:
        return 0.0
    if len(u) == len(v) and set(u) == set(v):
        return 100.0
    short, long = (u, v) if len(u) <= len(v) else (v, u)
    if short == long[: len(short)] or abbreviates(short, long) or abbreviates(long, short):
        return 95.0
    x, y = "".join(u), "".join(v)
    if x == y:
        return 100.0
    if len(x) >= 4 and (x in y or y in x):
        return 90.0
    return round(token_set_ratio(u, v), 1)


def abbreviates(a: list[str], b: list[str]) -> bool:
    """The one-letter words of a begin the first words of b, and its other words stand in b."""
    single = [w for w in a if len(w) == 1]
    return 0 < len(single) <= len(b) and single == [w[0] for w in b[: len(single)]] and all(w in b for w in a if len(w) > 1)


# ------------------------------------------------------------------------- keys


class Keys:
    """Keys of names under a bar; `asking` and `asked` keys meet only each other."""

    def __init__(self, least: float, hot: tuple[str, ...] = ()):
        self.hot = hot
        self.slack = 1 - (least - 0.051) / 100  # scores are rounded to tenths
        self.kept = (1 - self.slack) / (1 + self.slack)

    def edits(self, aside: int, n: int, m: int) -> int:
        return int(self.slack * (2 * aside + n + m))

    def partners(self, aside: int, n: int, begin: int, step: int) -> Iterator[tuple[int, int]]:
        """(length, edits) of the remains that one of n letters can be matched with."""
        m = begin
        while m > 0 and abs(m - n) <= self.edits(aside, n, m):
            yield m, self.edits(aside, n, m)
            m += step

    def of(self, words: list[str], left: bool) -> set[int]:
        out: set[int] = set()

        def put(role: str, *what: object) -> None:
            side = role if left else {"=": "=", "asking": "asked", "asked": "asking"}[role]
            out.add(xxhash.xxh64_intdigest(repr((side, *what))) - (1 << 63))

        row = "".join(words)
        put("=", "set", *sorted(words))
        put("=", "row", row)
        put("asking", "begins", *words)
        for k in range(1, len(words) + 1):
            put("asked", "begins", *words[:k])
        single, full = "".join(w for w in words if len(w) == 1), sorted([w for w in words if len(w) > 1], key=lambda w: (-len(w), w))
        if single:
            put("asking", "initials", single, *sorted(full[:2]))
        for k, some in itertools.product(range(1, len(words) + 1), [(), *itertools.combinations(sorted(words), 1), *itertools.combinations(sorted(words), 2)]):
            put("asked", "initials", "".join(w[0] for w in words[:k]), *some)
        put("asking", "within", row)
        least = 1 if left else 4
        for i, j in itertools.combinations(range(len(row) + 1), 2):
            if j - i >= least:
                put("asked", "within", row[i:j])
        for size in range(1, len(words) + 1):
            for shared in itertools.combinations(sorted(words), size):
                rest = [w for w in words if w not in shared]
                put("asked", "shared", *shared)
                if len(" ".join(shared)) >= self.kept * len(" ".join(words)) - 1e-9:
                    put("asking", "shared", *shared)
                if rest:
                    self._remains(put, shared, " ".join(sorted(rest)))
        self._remains(put, (), " ".join(sorted(words)))
        return out

    def _remains(self, put: object, shared: tuple[str, ...], rest: str) -> None:
        n, aside = len(rest), len(" ".join(shared)) + 1 if shared else 0
        own = rest.split(" ")
        known, free = [w for w in self.hot if w in own], ["", *(w for w in self.hot if w not in own)]
        if n <= SHORT:
            near = [*self.partners(aside, n, n, -1), *self.partners(aside, n, n + 1, 1)]
            dropped = max((edits + n - m) // 2 for m, edits in near if m <= SHORT)
            for k in range(min(dropped, n) + 1):
                for kept in itertools.combinations(rest, n - k):
                    put("=", "letters", shared, "".join(kept))
        for m, edits in self.partners(aside, n, max(n, SHORT + 1), 1):  # as the shorter one
            if n <= edits:
                put("asking", "short", shared, n, m)
            else:
                for i, (begin, end) in enumerate(segments(n, edits + 1)):
                    put("asking", "segment", shared, n, m, i, rest[begin:end], known[0] if known else "")
        if n > SHORT:
            for m, edits in self.partners(aside, n, n, -1):  # as the longer one
                if m <= edits:
                    put("asked", "short", shared, m, n)
                    continue
                for i, (begin, end) in enumerate(segments(m, edits + 1)):
                    for at in range(begin - (edits - n + m) // 2, begin + (edits + n - m) // 2 + 1):
                        if 0 <= at <= n - (end - begin):
                            part = rest[at : at + end - begin]
                            for mark in free:
                                put("asked", "segment", shared, m, n, i, part, mark)


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of `parts` even parts of n letters."""
    cuts = [n * k // parts for k in range(parts + 1)]
    return [*zip(cuts[:-1], cuts[1:], strict=True)]


# ------------------------------------------------------------------------- join


def distinct_names(rows: DataFrame, name: str) -> DataFrame:
    """(words, n): the distinct lists of words of a name column, and how many rows have each."""
    words = rows.select(compare.name_words(F.col(name)).alias("words")).where((F.size("words") > 0) & (F.size("words") <= MOST_WORDS))
    return words.groupBy("words").agg(F.count("*").alias("n"))


def frequent_words(*names: DataFrame) -> tuple[str, ...]:
    """The words of most names, KNOWN at most."""
    words = None
    for rows in names:
        found = rows.select(F.explode("words").alias("word"))
        words = found if words is None else words.unionAll(found)
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= HOT)
    return tuple(r["word"] for r in counted.orderBy(F.col("n").desc(), "word").limit(KNOWN).collect())


def keyed(names: DataFrame, least: float, left: bool, hot: tuple[str, ...] = ()) -> DataFrame:
    """(words, key) of distinct names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(least, hot)
        for batch in batches:
            for at, words in enumerate(batch.column("words").to_pylist()):
                found = sorted(keys.of(words, left))
                yield pa.RecordBatch.from_arrays([batch.column("words").take(pa.array([at] * len(found))), pa.array(found, pa.int64())], ["words", "key"])

    return names.select("words").mapInArrow(run, "words array<string>, key bigint")


def candidates(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """(u, v): pairs of distinct word lists that share a key."""
    hot = frequent_words(left, right)
    a = keyed(left, least, True, hot).select(F.col("words").alias("u"), "key")
    b = keyed(right, least, False, hot).select(F.col("words").alias("v"), "key")
    return a.join(b, "key").select("u", "v").distinct()


def similar(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """(u, v, score) of all pairs of the word lists of left and right that score at least `least` (more than 50)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([score(u, v) for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), found], ["u", "v", "score"])

    rows = candidates(left, right, least).mapInArrow(run, "u array<string>, v array<string>, score double")
    return rows.where(F.col("score") >= least)
