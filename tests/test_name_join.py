"""The similarity join of names against all pairs."""

from __future__ import annotations

import random

import pytest

from docketry.operators import name_join


def names(seed: int, n: int) -> list[list[str]]:
    rng, letters = random.Random(seed), "aeiourmnkslth"
    pool = ["kumar", "ramesh", "rajesh", "lal", "devi", "singh", "mohan", "ram", "r", "k", "m", "patel", "parmar", "venkatasubramanian"]
    out = []
    for _ in range(n):
        words = [rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.5 and out:  # slips of an earlier one
            words = list(rng.choice(out))
            for _ in range(rng.randrange(1, 4)):
                k = rng.randrange(len(words))
                at = rng.randrange(len(words[k]) + 1)
                words[k] = words[k][:at] + rng.choice(["", rng.choice(letters)]) + words[k][at + rng.randrange(2) :]
            if rng.random() < 0.3:
                rng.shuffle(words)
            if rng.random() < 0.2 and len(words) > 1:
                words = ["".join(words[:2]), *words[2:]]
        words = [w for w in dict.fromkeys(words) if w]
        if words and words not in out:
            out.append(words)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_keys_of_every_similar_pair_meet(seed):
    left, right = names(seed, 300), names(seed + 10, 300) + names(seed, 200)
    keys = name_join.Keys(name_join.LEAST, ("kumar", "ramesh", "venkatasubramanian", "patel") if seed == 2 else ())
    asked, found = [keys.of(w, False) for w in right], 0
    for u in left:
        own = keys.of(u, True)
        for v, other in zip(right, asked, strict=True):
            if name_join.score(u, v) >= name_join.LEAST:
                found += 1
                assert own & other, (u, v, name_join.score(u, v))
    assert found > 800


def test_similar_names_are_those_of_all_pairs(spark):
    left, right = names(21, 150), names(22, 150) + names(21, 60)
    frames = [spark.createDataFrame([(w,) for w in x], "words array<string>").distinct() for x in (left, right)]
    found = {(tuple(r.u), tuple(r.v)): r.score for r in name_join.similar(*frames).collect()}
    scores = {(tuple(u), tuple(v)): name_join.score(u, v) for u in left for v in right}
    assert found == {k: s for k, s in scores.items() if s >= 85} and len(found) > 150


def test_tiers():
    def of(a, b):
        return name_join.score(a.split(), b.split())

    assert of("ramesh kumar", "kumar ramesh") == 100 and of("unkar", "unkar lal") == 95 and of("r kumar", "ramesh kumar") == 95
    assert of("ram lal", "ramlal") == 100 and of("anand", "vivekanand") == 90 and of("ramesh kumar", "ramesh lal kumar") == 100
    assert of("", "x") == 0 and of("peeru", "piru") < 85 and of("mosmee", "mosami") < 85
    assert name_join.token_set_ratio(["kumar", "ramesh"], ["kumar", "rajesh"]) == pytest.approx(100 * (1 - 2 / 24))


def test_a_word_of_a_third_of_the_names_makes_no_pairs_of_its_own(spark):
    rng, made = random.Random(5), {}
    for n in (300, 600):
        rows = [[*(["kumar"] if k % 3 == 0 else []), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))] for k in range(n)]
        frame = spark.createDataFrame([(w,) for w in rows], "words array<string>")
        made[n] = name_join.candidates(frame, frame).count()
    assert made[600] <= 2.2 * made[300] and made[600] < 1000, made  # 600 are pairs of a name and itself
