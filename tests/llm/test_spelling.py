"""Spelling variants against a brute-force version, over odd texts and words made to be near."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from sceneweave.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, key string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def brute(rows, length=6, least=5):
    counts = {w: n for w, n in brute_counts(rows).items() if len(w) >= length and n >= least}
    links = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if near(a, b):
            links[a].append(b)
            links[b].append(a)
    form = {w: min(x, key=lambda v: (-counts[v], v)) for w, x in links.items() if x}
    form = {w: f for w, f in form.items() if counts[f] >= 5 * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(links[w]), counts.get(form.get(w))))
    return Counter(out)


def mutated(rng, word):
    at, c = rng.randrange(len(word) + 1), rng.choice("abcdeéß÷")
    return rng.choice([word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :]])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    alphabets = ["ab", "abcdefghij", "xyzéèÀ"]
    base = ["".join(rng.choice(a) for _ in range(rng.randrange(6, 11))) for a in alphabets for _ in range(40)]
    words = Counter({w: rng.choice([5, 30, 150]) for w in base})
    for w in base:
        for _ in range(4):
            other = mutated(rng, w)
            words[other] += rng.choice([1, 5, 6, 30])
            words[mutated(rng, other)] += 5
    bag = [w.capitalize() if rng.random() < 0.2 else w for w, n in words.items() for _ in range(n)]
    rng.shuffle(bag)
    out = [(i, ", ".join(bag[at : at + 150]), "clash", 1, "k") for i, at in enumerate(range(0, len(bag), 150))]
    odd = [None, "", " \n", "a", "AB cd", "x" * 300_000, "aaaaaa " * 30_000, "日本語 " * 9, "abcdef́ " * 6, "Ünïcode÷× " * 7]
    out += [(1000 + i, t, None, None, None) for i, t in enumerate(odd)]
    return [*out, out[3], (None, out[4][1], "null id", 0, ""), (None, None, None, None, None)]


def test_matches_brute_force(spark, rows):
    want = brute(rows)
    got = Counter(tuple(r) for r in spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    assert got == want
    assert sum(r[1] is not None for r in want) > 30 and sum(r[1] is not None and r[1] != r[2] for r in want) > 2


def test_other_limits(spark, rows):
    got = Counter(tuple(r) for r in spelling.variants(spark.createDataFrame(rows, SCHEMA), least_length=4, least_count=20).collect())
    assert got == brute(rows, 4, 20)
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame(rows, SCHEMA), least_length=3)


def test_empty_table(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert spelling.variants(frame.where("1 = 0")).count() == 0
    assert spelling.variants(frame.where("text IS NULL")).count() == 0


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(1)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randrange(2, 7)))
        cost = [rng.randrange(9) for _ in places]
        pairs = [(cost[i] + cost[j]) for i, j in combinations(range(len(places)), 2) if places[j] - places[i] >= 2]
        got = spelling.pivots(places, cost)
        assert bool(got) == bool(pairs)
        if got:
            assert got[1] - got[0] >= 2 and sum(cost[places.index(p)] for p in got) == min(pairs)


def test_pairs_among_words_that_rarely_meet(spark):
    """Random words of an even alphabet: the few pairs are found, and nothing else."""
    words = ["".join(x) for x in {tuple(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=9)) for i in range(3000)}]
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = {(r.a, r.b) for r in spelling.near_pairs(frame).collect()}
    assert pairs == {(min(a, b), max(a, b)) for a, b in combinations(words, 2) if near(a, b)}
