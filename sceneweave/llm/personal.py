"""Personal data: fixed patterns, and what labelers that vote on looser candidates agree on.

Base spans are those of fixed patterns, always. Beside them are candidates that
look like an address, a network address, a card or a phone number in a looser way:
"jo (at) mail dot org", "(030) 555 0142", "4111.1111.1111.1111". On each candidate,
base spans included, six labelers vote for, against or not at all: patterns, a
check of the form, gazetteers (ends of host names, issuers' and countries' numbers,
reserved networks), the words before it, and what stands around it.

How far each labeler can be trusted is estimated by expectation-maximisation over
all candidates of the corpus: given whether a candidate is personal data, votes are
taken as independent. Only the counts of the combinations of votes matter, of which
there are 729 a kind, however large the corpus. The probabilities that come out are
the labels for a span classifier (logistic regression in numpy), which also sees
the candidate's shape. It decides on the candidates that no base span holds.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneweave.llm.common import cut_lineage, map_batches

# The kinds in their order, and what base spans are made of.
BASE = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9][0-9]*+(?:(?:\.[0-9]++){3})?")  # numbers that begin no address are passed over whole
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

KINDS = (*BASE, *(f"likely_{k}" for k in BASE))
#: Characters before and behind a candidate that labelers look at.
BEFORE, BEHIND = 48, 16

# Looser forms. Every repetition is bounded, so that a text of any kind takes time in proportion to its length, and each begins with characters that prose seldom has.
AT = re.compile(r"[\[({@](?:(?<=@)|\s?[Aa][Tt]\s?[\])}])")
SPOKEN = re.compile(r"(?<=\x20)at(?=\x20[\w-]{1,63}\x20dot\x20)")
LOOSE_LOCAL = re.compile(r"[\w.%+-]{1,64}(?=\s?\Z)")
SPACE = re.compile(r"\s?")
LOOSE_HOST = re.compile(r"[\w-]{1,63}(?:(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\x20dot\x20)[\w-]{1,63}){1,5}", re.IGNORECASE)
BROKEN_IP = re.compile(r"[0-9](?<![\w.:][0-9])[0-9]{0,2}(?:\s?[\[(]\s?(?:\.|dot)\s?[\])]\s?[0-9]{1,3}){3}(?!\w)")
LONG_IP = re.compile(r"[0-9A-Fa-f:](?<![\w.:][0-9A-Fa-f:])(?:(?<=:):(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{0,3}:(?:[0-9A-Fa-f]{1,4}:){1,6}(?::?[0-9A-Fa-f]{1,4}){0,6})(?![\w:])")
COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
LOOSE_NUMBER = re.compile(r"[(0-9](?<![\w+.,/(-][(0-9])[0-9]{0,6}\)?(?:[\x20()./\u2010-\u2014\u00A0-]{1,2}[0-9]{1,6}){1,6}(?!\w)")

LABELERS = ("pattern", "form", "gazetteer", "words for", "words against", "surroundings")
WORDS_FOR = {
    "email": "email e-mail mail contact write correo courriel kontakt schreiben adresse reply",
    "ip": "ip ipv4 ipv6 host server address client login from ping adresse",
    "card": "card visa mastercard amex credit debit karte tarjeta carte payment paid",
    "phone": "phone tel telephone telefon fax mobile call cell telefono teléfono téléphone handy anrufen ring contact whatsapp",
}
WORDS_AGAINST = set("version ver v release build isbn issn doi page pages pp chapter section fig figure table vol no nr id order invoice sum total sha md5 hash commit date time score ratio room seite página".split())
UNITS = re.compile(r"\s?(?:%|€|\$|£|kg|km|cm|mm|m2|mb|gb|usd|eur|px|°)", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
NUMBER = re.compile(r"[0-9]+")
HOST_ENDS = set("com org net edu gov mil int info biz io co eu uk de fr es it nl be at ch se no dk fi pl pt ie gr cz ru ua jp cn kr in au nz ca us mx br ar cl za".split())
FILE_ENDS = set("png jpg jpeg gif svg pdf txt md csv json xml html htm js css py java c h cpp rs go sh zip gz tar exe dll log".split())
DATES = re.compile(r"(?:19|20)[0-9]{2}\D(?:0?[1-9]|1[0-2])\D(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])\D(?:0?[1-9]|1[0-2])\D(?:19|20)?[0-9]{2}")
TELEPHONE_SHAPES = re.compile(r"\(?[0-9]{2,5}\)?\D{1,2}[0-9]{3,4}\D[0-9]{3,5}|00[1-9][0-9]{0,2}\D.*")


def digits_of(text: str) -> str:
    return "".join(NUMBER.findall(text))


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and not overlapping within a kind."""
    found, free, last = [], 0, 0
    at = text.find("@")
    while at >= 0:
        local = text[max(free, last) : at]
        start = at - (len(local) - len(local.rstrip(LOCAL)))
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            found.append(("email", start, host.end()))
            free = host.end()
        last = at + 1
        at = text.find("@", last)
    found += [("ip", *m.span()) for m in IP.finditer(text) if "." in m[0] and all(int(p) <= 255 for p in _short(m[0].split(".")))]
    for kind, pattern, least, most in (("card", CARD, 12, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= least:
                digits = digits_of(m[0])
                if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                    found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0])))


def _short(parts: list[str]) -> list[str]:
    """Numbers without leading zeros; those of over three digits are too large, whatever they are."""
    return [p if len(p) < 4 else (p.lstrip("0") or "0")[:4] for p in parts]


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of looser candidates; kinds may overlap."""
    found = []
    for m in [*AT.finditer(text), *(SPOKEN.finditer(text) if " dot " in text else ())]:
        first = max(0, m.start() - 65)
        local, host = LOOSE_LOCAL.search(text[first : m.start()]), LOOSE_HOST.match(text, SPACE.match(text, m.end()).end())
        if local and host:
            found.append(("email", first + local.start(), host.end()))
    found += [("ip", *m.span()) for m in BROKEN_IP.finditer(text)]
    if COLONS.search(text):
        found += [("ip", *m.span()) for m in LONG_IP.finditer(text)]
    for m in LOOSE_NUMBER.finditer(text):
        n = len(digits_of(m[0]))
        if 7 <= n <= 15:
            found.append(("phone", *m.span()))
        if 12 <= n <= 19:
            found.append(("card", *m.span()))
    return found


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it is a base span): base spans, and looser ones that lie in none."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    ends, furthest = [], 0
    for _, _, end in base:
        furthest = max(furthest, end)
        ends.append(furthest)
    starts = np.array([s[1] for s in base])
    for kind, start, end in loose_spans(text):
        before = int(np.searchsorted(starts, start, side="right"))
        if not before or ends[before - 1] < end:
            out.append((kind, start, end, False))
    return out


def _address(value: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    try:
        return ipaddress.ip_address(re.sub(r"\s?[\[(]\s?(?:\.|dot)\s?[\])]\s?", ".", value, flags=re.IGNORECASE))
    except ValueError:
        return None


def votes(text: str, kind: str, start: int, end: int, base: bool) -> list[int]:
    """What each labeler says: 1 for personal data, -1 against, 0 nothing."""
    value, digits = text[start:end], digits_of(text[start:end])
    ahead, behind = text[max(0, start - BEFORE) : start], text[end : end + BEHIND]
    words = [w.lower() for w in WORD.findall(ahead)][-6:]
    pattern = 1 if base else 0
    if kind == "email":
        host_end = re.split(r"\W+", value)[-1].lower()
        name = re.split(r"@|\W?at\W", value, maxsplit=1, flags=re.IGNORECASE)[0].strip()
        form = 1 if 1 <= len(name) <= 64 and re.search(r"\w", name) and ".." not in value and host_end.isalpha() and len(host_end) > 1 else -1
        gazetteer = 1 if host_end in HOST_ENDS else -1 if host_end in FILE_ENDS else 0
    elif kind == "ip":
        address = _address(value)
        form = -1 if address is None else 1
        gazetteer = 0 if address is None else -1 if address.is_loopback or address.is_unspecified or address.is_multicast else 1 if address.is_global else 0
    elif kind == "card":
        form = 1 if luhn(digits) and len(set(digits)) > 2 else -1
        gazetteer = 1 if re.match(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38", digits) and len(digits) >= 13 else -1
    else:
        form = -1 if not 7 <= len(digits) <= 15 or DATES.fullmatch(value.strip("()")) or len(set(digits)) < 3 else 1 if base or TELEPHONE_SHAPES.fullmatch(value) else 0
        gazetteer = 1 if re.match(r"\+|00[1-9]|\(?0[1-9]|\(?[2-9][0-9]{2}\)?\D[0-9]{3}\D[0-9]{4}\Z", value) else 0
    known = WORDS_FOR[kind].split()
    words_for = 1 if any(w in known for w in words[-4:]) else 0
    words_against = -1 if any(w in WORDS_AGAINST for w in words[-2:]) or UNITS.match(behind) else 0
    numbers = len(NUMBER.findall(ahead)) + len(NUMBER.findall(behind))
    glued = (ahead[-1:].isalnum() and kind != "email") or behind[:1].isalnum() or ahead.rstrip()[-1:] in ("=", "*", "/", "<", ">", "^", "$", "€", "£")
    return [pattern, form, gazetteer, words_for, words_against, -1 if glued or numbers >= 4 else 1 if numbers == 0 else 0]


def combination(found: list[int]) -> int:
    """The votes as one number, in base three."""
    out = 0
    for v in found:
        out = 3 * out + v + 1
    return out


def combinations_votes(codes: np.ndarray) -> np.ndarray:
    """(codes, labelers) votes."""
    out = np.zeros((len(codes), len(LABELERS)), int)
    for j in range(len(LABELERS) - 1, -1, -1):
        codes, out[:, j] = codes // 3, codes % 3 - 1
    return out


def shape(text: str, start: int, end: int) -> list[float]:
    """What the classifier sees of a candidate besides its votes."""
    value = text[start:end]
    n, groups = end - start, NUMBER.findall(value)
    marks = sum(not c.isalnum() for c in value)
    return [min(n, 64) / 32, sum(map(len, groups)) / n, marks / n, len(groups) / 6, float(text[max(0, start - 1) : start].isspace() or start == 0), float(not text[end : end + 1].isalnum()), float("\n" in text[max(0, start - 3) : start] or start < 3)]


N_SHAPE = 7


@dataclass
class LabelModel:
    """Reliabilities of the labelers of one kind."""

    share: float  # of candidates that are personal data
    chances: np.ndarray  # (2, labelers, 3): of each vote where the truth is 0 or 1

    def probabilities(self, found: np.ndarray) -> np.ndarray:
        """For rows of votes: how likely each candidate is personal data."""
        logs = np.log(self.chances)[:, np.arange(found.shape[1]), found + 1].sum(axis=2)
        odds = logs[1] - logs[0] + np.log(self.share) - np.log1p(-self.share)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


#: What is believed before any candidate is seen, as so many candidates' votes: labelers are right in most cases.
BELIEF, TRUST = 20.0, {1: 0.7, 0: 0.2, -1: 0.1}


def expectation_maximisation(found: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Fit a label model to combinations of votes (rows, labelers) and how often each occurs."""
    labelers = found.shape[1]
    belief = np.empty((2, labelers, 3))
    belief[1] = [TRUST[v] for v in (-1, 0, 1)]
    belief[0] = [TRUST[-v] for v in (-1, 0, 1)]
    model = LabelModel(0.5, belief.copy())
    before = None
    for _ in range(rounds):
        p = model.probabilities(found) * counts if len(found) else np.zeros(0)
        weights = np.stack([counts - p, p]) if len(found) else np.zeros((2, 0))
        chances = belief * BELIEF
        for v in (-1, 0, 1):
            chances[:, :, v + 1] += weights @ (found == v)
        model = LabelModel(float((weights[1].sum() + BELIEF / 2) / (weights.sum() + BELIEF)), chances / chances.sum(axis=2, keepdims=True))
        if before is not None and np.abs(model.chances - before).max() < 1e-7:
            break
        before = model.chances
    return model


def features(kinds: np.ndarray, found: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """(candidates, features): votes for, votes against and shape, a set of weights for each kind."""
    own = np.concatenate([np.ones((len(kinds), 1)), found > 0, found < 0, shapes], axis=1)
    out = np.zeros((len(kinds), len(BASE), own.shape[1]))
    out[np.arange(len(kinds)), kinds] = own
    return out.reshape(len(kinds), len(BASE) * own.shape[1])


def fit(x: np.ndarray, soft: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on labels between 0 and 1, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - soft)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Scanner:
    """What was learned: a label model for each kind, and the classifier's weights."""

    models: list[LabelModel]
    weights: np.ndarray

    def scores(self, kinds: np.ndarray, found: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(kinds, found, shapes) @ self.weights, -30, 30)))


def train(docs: DataFrame, text_col: str = "text", most_rows: int = 8_000) -> Scanner:
    """Learn from all candidates of all texts.

    Reliabilities come from the counts of every combination of votes. The
    classifier is fitted on about ``most_rows`` candidates of each kind, or all if
    there are fewer, chosen by a hash of the text, the place and the kind, with a
    threshold from the kind's count; each stands for as many as were left out.
    Without candidates the labelers are trusted as believed beforehand.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, codes, shapes, places = [], [], [], []
        for i, x in enumerate(batch.column("text")):
            text = x.as_py()
            for kind, start, end, base in candidates(text):
                kinds.append(BASE.index(kind))
                codes.append(combination(votes(text, kind, start, end, base)))
                shapes.append(shape(text, start, end))
                places.append(f"{start}:{text[max(0, start - BEFORE) : end + BEHIND]}")
        columns = [pa.array(kinds, pa.int32()), pa.array(codes, pa.int32()), pa.array(shapes, pa.list_(pa.float32())), pa.array(places, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "code", "shape", "place"])

    looked = map_batches(texts, look, "kind int, code int, shape array<float>, place string")
    seen = cut_lineage(looked.select("kind", "code", "shape", F.xxhash64("place", "kind").alias("mark")))
    counts = seen.groupBy("kind", "code").count().collect()
    models, shares = [], []
    for k in range(len(BASE)):
        own = [r for r in counts if r["kind"] == k]
        n = np.array([r["count"] for r in own], float)
        models.append(expectation_maximisation(combinations_votes(np.array([r["code"] for r in own], int)), n))
        shares.append(min(1.0, most_rows / max(1.0, n.sum())))
    # The share of all 64-bit hashes below a threshold.
    limits = F.element_at(F.array(*[F.lit(int(-(2**63) + s * (2**64 - 2**12))) for s in shares]), F.col("kind") + 1)
    chosen = seen.where(F.col("mark") <= limits).select("kind", "code", "shape").toPandas()
    kinds = chosen["kind"].to_numpy(int)
    found = combinations_votes(chosen["code"].to_numpy(int))
    shapes = np.stack(chosen["shape"].to_list()) if len(chosen) else np.zeros((0, N_SHAPE))
    # Combinations as the label models see them stand beside the sample, so that a kind with few candidates is learned, too.
    every = combinations_votes(np.arange(3 ** len(LABELERS)))
    prior_kinds = np.repeat(np.arange(len(BASE)), len(every))
    prior_found = np.tile(every, (len(BASE), 1))
    prior_shapes = np.concatenate([np.tile(shapes[kinds == k].mean(axis=0) if (kinds == k).any() else np.full(N_SHAPE, 0.5), (len(every), 1)) for k in range(len(BASE))])
    x = np.concatenate([features(kinds, found, shapes), features(prior_kinds, prior_found, prior_shapes)])
    all_kinds, all_found = np.concatenate([kinds, prior_kinds]), np.concatenate([found, prior_found])
    soft = np.zeros(len(x))
    for k, model in enumerate(models):
        soft[all_kinds == k] = model.probabilities(all_found[all_kinds == k])
    weight = np.concatenate([np.ones(len(kinds)), np.full(len(prior_kinds), BELIEF / len(every))])
    return Scanner(models, fit(x, soft, weight))


def find_personal(text: str | None, scanner: Scanner, least: float = 0.9) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind: all base spans, and the looser candidates that score ``least`` and have two labelers for them.

    Of looser candidates that overlap, the best stays (ties: the first).
    """
    if not text:
        return []
    every = candidates(text)
    if not every:
        return []
    found = np.array([votes(text, *c) for c in every])
    kinds = np.array([BASE.index(c[0]) for c in every])
    scores = scanner.scores(kinds, found, np.array([shape(text, c[1], c[2]) for c in every]))
    out = [(kind, start, end, float(score)) for (kind, start, end, base), score in zip(every, scores, strict=True) if base]
    likely = sorted((start, end, -float(score), kind) for (kind, start, end, base), score, v in zip(every, scores, found, strict=True) if not base and score >= least and (v > 0).sum() >= 2)
    for group in overlapping(likely):
        taken: list[tuple[int, int]] = []
        for start, end, score, kind in sorted(group, key=lambda s: (s[2], s)):
            if all(end <= a or b <= start for a, b in taken):
                taken.append((start, end))
                out.append((f"likely_{kind}", start, end, -score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def overlapping(spans: list[tuple]) -> list[list[tuple]]:
    """Sorted spans (start, end, ...) in groups, none of which reaches into another."""
    groups: list[list[tuple]] = []
    furthest = -1
    for s in spans:
        if s[0] >= furthest:
            groups.append([])
        groups[-1].append(s)
        furthest = max(furthest, s[1])
    return groups


def scan(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, score>>: one row per input row, an empty array for null and clean texts.

    Places are in code points, ends exclusive. Kinds are those of base spans and
    ``likely_`` ones, which no base span holds. Without a ``scanner`` one is
    trained on all of ``docs``. Repeated rows and null ids are rows like any
    other; other columns are not read. A text of any length is scanned whole.
    """
    scanner = scanner or train(docs, text_col)
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_personal(x.as_py(), scanner, least)] for x in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, struct)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, work, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), n_likely, base_sha256, spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda test, name: F.size(F.filter("spans", test)).cast("long").alias(name)
    base = F.filter("spans", lambda s: ~s["kind"].startswith("likely_"))
    is_kind = lambda kind: lambda s: s["kind"] == kind
    counts = [count(is_kind(k), f"n_{k}") for k in BASE]
    return scanned.select("doc_id", *counts, count(lambda s: s["kind"].startswith("likely_"), "n_likely"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
