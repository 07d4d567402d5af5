"""Small document tables with every hard case, and plain versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")
#: Columns whose names operators might use themselves.
CLASHES = "id doc row n kept score predicted label bucket copy digest alt best size copies taken target words th h grp order piece start length offset sequence_id _p _b _m _maybe _id n_lines kept_text covered lines pid sketch content meta".split()


def table(spark: SparkSession, rows: list[tuple[int | None, str | None]], clash: bool = False, source=lambda i: f"s{(i or 0) % 4}") -> DataFrame:
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    full = [(i, t, None if i == 2 else "en", source(i), len(t or "")) for i, t in rows]
    if clash:
        schema += "".join(f", `{c}` string" for c in CLASHES)
        full = [(*r, *["x"] * len(CLASHES)) for r in full]
    return spark.createDataFrame(full, schema)


def prose(seed: int, n: int, vocabulary: int = 3000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def hard_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty, blank, short, long, Unicode, equal, repeated, nearly equal and sharing texts."""
    base, passage, long = prose(1, 400), prose(2, 70), prose(3, 30_000)
    near = base.copy()
    near[200] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, "a b"), (6, "Übergröße naïve 😀 x y z"), (7, " ".join(base)), (8, " ".join(near)), (9, " ".join(base)),
        (10, " ".join(prose(4, 60) + passage + prose(5, 60))), (11, " ".join(passage + prose(6, 90))), (12, " ".join(prose(7, 20) + passage)), (13, " ".join(long)),
        (14, " ".join(long[:20_000] + prose(8, 900))), (15, "a b"), (15, "a b"), (16, " ".join(prose(9, 300))), (16, " ".join(prose(10, 300))), (None, " ".join(prose(11, 80))), (None, None),
        (17, " ".join(["again"] * 500)), (18, " ".join(["again"] * 300)), (19, "l1\nl2\nl3\nl4"), (20, "x\nl1\nl2\nl3\nl4\nl1\nl2\nl3"), (21, "l1\nl2\nl3"), (22, "word" * 5000), (23, "\n\n\n\n"), (24, "\n\n\n"),
    ]
    return rows


def shingles(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in WORDS.findall(text or "")]
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def near_classes(rows: list[tuple[int | None, str | None]], least: float = 0.8) -> dict[int, int]:
    """The smallest id of each id's class, by all pairs."""
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in rows}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, s) in enumerate(rows):
        for j, t in rows[:a]:
            if s and t and min(len(s), len(t)) >= least * max(len(s), len(t)):
                both = len(s & t)
                if both >= least * (len(s) + len(t) - both):
                    a_root, b_root = sorted((find(i), find(j)))
                    root[b_root] = a_root
    return {i: find(i) for i, _ in rows}


def without_repeats(rows: list[tuple[int | None, str | None]], window: int = 50) -> Counter:
    """(id, words, removed words, kept text) of each row, by a table of all windows."""
    first: dict[tuple[str, ...], int] = {}
    split = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, words in split:
        if i is not None:
            for k in range(len(words) - window + 1):
                key = tuple(words[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, words in split:
        gone = [False] * len(words)
        if i is not None:
            for k in range(len(words) - window + 1):
                if first[tuple(words[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        out[i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)] += 1
    return out
