"""Personal data: base spans against plain patterns, the label model against known reliabilities, planted looser forms."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from sceneweave.llm import personal

SCHEMA = "doc_id long, text string, kind string, spans string, mark long"
ODD = [None, "", " \n\t", "a", "日本 42 テスト", "x" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 60_000, "+1 " * 60_000, "9-" * 60_000, "(0) " * 60_000, "[at]" * 30_000, "a@b.c" * 2_000]


def plain(text):
    """The base spans by finditer and a check of each match."""
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in digits(m)]
        total = sum(d[-1::-2]) + sum(sum(divmod(2 * c, 10)) for c in d[-2::-2])
        out += [("card", *m.span())] if 12 <= len(d) <= 19 and total % 10 == 0 else []
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], personal.BASE.index(s[0])))


def some_text(rng):
    bits = ["@", ".", "..", " ", "-", "+", "(", ")", "1", "25", "255", "256", "0007", "4111111111111111", "4111 1111 1111 1111", "a", "b.c", "é", "x_y%", "+49 30 5550142", "\n", "10.0.0.1", "jo@mail.org", ","]
    return "".join(rng.choices(bits, k=rng.randrange(1, 25)))


def test_base_spans_match_plain_patterns():
    rng = random.Random(2)
    found = 0
    for _ in range(6000):
        text = some_text(rng)
        assert personal.base_spans(text) == plain(text), text
        found += len(plain(text))
    assert found > 3000


def test_long_texts_take_time_in_proportion():
    for text in ODD:
        began = time.time()
        personal.candidates(text or "")
        assert time.time() - began < 10


def test_label_model_finds_reliabilities():
    rng = np.random.default_rng(3)
    n, right = 40_000, np.array([0.95, 0.9, 0.8, 0.75, 0.7, 0.6])
    truth = rng.random(n) < 0.3
    spoken = rng.random((n, 6)) < 0.8
    votes = np.where(rng.random((n, 6)) < right, 1, -1) * np.where(truth, 1, -1)[:, None] * spoken
    codes, counts = np.unique([personal.combination(v) for v in votes.tolist()], return_counts=True)
    assert (personal.combinations_votes(np.array([personal.combination(v) for v in votes[:50].tolist()])) == votes[:50]).all()
    model = personal.expectation_maximisation(personal.combinations_votes(codes), counts.astype(float))
    assert abs(model.share - 0.3) < 0.02
    learned = model.chances[1, :, 2] / (model.chances[1, :, 2] + model.chances[1, :, 0])
    assert np.abs(learned - right).max() < 0.03
    best = ((model.probabilities(votes) > 0.5) == truth).mean()
    majority = ((votes.sum(axis=1) > 0) == truth).mean()
    assert best > majority + 0.01


PLANTED = {
    "likely_email": ["Please write an e-mail to jo.smith (at) mail [dot] org today.", "contact: anna at firma dot de please", "kontakt müller@firma.de heute"],
    "likely_phone": ["You can phone (030) 555 0142 on weekdays.", "Tel: 0171-555-01423 mobil", "call 301-555-0142 please"],
    "likely_card": ["paid by card 4111.1111.1111.1111 then"],
    "likely_ip": ["login from 93[.]184[.]216[.]34 seen", "the server 2606:2800:220:1:248:1893:25c8:1946 answers"],
}
CLEAN = ["It rained on 2024-01-15 and 1999-12-31.", "Release 1:2:3 of 12:30:45 takes 12 345 678 kg.", "The ratio is 3.14159 of page 12 345 678.", "Nobody is at home. A dot on the map.", "isbn 978 0 306 40615 7 is a book", "Sum 100 200 300 400 500 600 of 700 800"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    texts = [t and t[:3000] for t in ODD] + [t for found in PLANTED.values() for t in found] + CLEAN
    filler = "the river runs through the old town where people meet "
    for i in range(400):
        kind = rng.choice(["jo%d@mail.org" % i, "+49 30 555%04d" % i, "4111 1111 1111 1111", "93.184.%d.%d" % (i % 256, i % 200), "on 2024-01-%02d" % (i % 28 + 1), "order 123 456 %03d" % i, "8.1.2.%d" % i])
        texts.append(filler * rng.randrange(1, 3) + kind + " " + filler)
    out = [(i, t, "clash", "s", 1) for i, t in enumerate(texts)]
    return [*out, out[16], (None, "null id: jo@mail.org", None, None, None), (None, None, None, None, None)]


def test_scan_keeps_base_spans_and_adds_planted_ones(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    scanned = personal.scan(frame)
    got = sorted(((r.doc_id, [tuple(s)[:3] for s in r.spans]) for r in scanned.collect()), key=repr)
    assert len(got) == len(rows)
    want = sorted(((r[0], plain(r[1])) for r in rows), key=repr)
    assert [(i, [s for s in spans if not s[0].startswith("likely_")]) for i, spans in got] == want
    by_text = {r[1]: next(spans for i, spans in got if i == r[0]) for r in rows if r[0] is not None}
    for kind, texts in PLANTED.items():
        for text in texts:
            assert kind in [s[0] for s in by_text[text]], text
    for text in CLEAN:
        assert not [s for s in by_text[text] if s[0].startswith("likely_")], text
    assert all(not [s for s in spans if s[0].startswith("likely_")] for t, spans in by_text.items() if t and "2024-01-" in t)
    spans = {i: s for i, s in got if i is not None}
    for r in personal.digests(scanned).where("doc_id IS NOT NULL").collect():
        base = [s for s in spans[r.doc_id] if not s[0].startswith("likely_")]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_likely] == [*(sum(s[0] == k for s in base) for k in personal.BASE), len(spans[r.doc_id]) - len(base)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans[r.doc_id])


def test_nothing_to_learn_from(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert personal.scan(frame.where("1 = 0")).count() == 0
    assert [r.spans for r in personal.scan(frame.where("text IS NULL OR text = ''")).collect()] == [[]] * 3
    alone = spark.createDataFrame([(1, PLANTED["likely_email"][0], "", "", 0)], SCHEMA)
    assert [s.kind for s in personal.scan(alone).first().spans] == ["likely_email"]


def test_sample_is_bounded_and_stands_for_all(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    small, large = personal.train(frame, most_rows=50), personal.train(frame)
    for a, b in zip(small.models, large.models, strict=True):
        assert np.allclose(a.chances, b.chances) and a.share == pytest.approx(b.share)
