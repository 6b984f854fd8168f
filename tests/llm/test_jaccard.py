"""The pipeline's near-duplicates against brute force over shingle sets."""

import corpus_pipeline
import numpy as np
import pytest

from sceneweave.llm import jaccard, simhash


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(words), n, replace=False):
        out[at] = f"z{rng.integers(10**9)}"
    return out


def corpus():
    """Texts with edits on both sides of 0.8, a large group around one text, a chain, blanks and short texts."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = []
    for length in (30, 60, 100, 200, 400):
        for n in range(10):
            base = words(length)
            texts += [" ".join(base), " ".join(edited(rng, base, max(1, n * length // 200)))]
    base = words(200)
    texts += [" ".join(edited(rng, base, 5)) for _ in range(60)]
    step = words(150)
    for _ in range(8):
        texts.append(" ".join(step))
        step = step[10:] + words(10)
    return [*texts, "", "  ", None, "One two", "one TWO", "one two three"]


@pytest.mark.parametrize("unit_rows", [512, 7])
def test_near_duplicates_are_those_of_exact_similarity(spark, unit_rows):
    texts = corpus()
    sets = [shingles(t or "") for t in texts]
    roots = list(range(len(texts)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    missed = joined = 0
    for i in range(len(texts)):
        for j in range(i):
            far = (simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[j], 5)).bit_count()
            if similarity(sets[i], sets[j]) >= 0.8:
                missed += far > 6
                x, y = find(i), find(j)
                roots[max(x, y)] = min(x, y)
            else:
                joined += far <= 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, unit_rows=unit_rows).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert missed > 10 and joined > 0  # fingerprints alone are wrong on both sides here
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values()))


def test_bands_hold_pairs_of_the_least_similarity():
    """Sets at 0.8 share a bucket; at 0.2 they seldom do."""
    rng = np.random.default_rng(3)
    for both, own, least, most in ((160, 20, 2000, 2000), (40, 80, 0, 200)):
        hits = 0
        for _ in range(2000):
            x = rng.integers(0, 2**63, both + 2 * own, dtype=np.uint64)
            hits += bool((jaccard.band_keys(x[: both + own]) == jaccard.band_keys(np.concatenate((x[:both], x[both + own :])))).any())
        assert least <= hits <= most
