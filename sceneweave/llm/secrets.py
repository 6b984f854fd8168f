"""Secret scans: fixed patterns, and the entropy of sliding windows.

Strings of token characters are cut into runs of one character class: hex digits,
letters and digits, and the string itself. Within a run a window slides over the
characters; its Shannon entropy follows from counts that each step changes by
one character in and one out. A window over the class's threshold makes the
whole run a span, unless an allow-list rule explains the run.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneweave.llm.common import map_batches

# The base patterns and least lengths, in the order in which kinds are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "entropy")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A candidate is a maximal string of token characters; the runs in it are examined, too.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
RUNS = (re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}"), re.compile(r"[A-Za-z0-9]{20,}"))
WINDOW = 20
#: Class, its characters, and the entropy in bits from which a window counts.
CLASSES = (("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 3.0), ("alphanumeric", re.compile(r"[A-Za-z0-9]+"), 3.6), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.8))
HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
CONSONANTS = re.compile(r"[b-df-hj-np-tv-xz]{9}", re.IGNORECASE)


def word_like(letters: str) -> bool:
    """Short, or words run together: parts of two letters at least and of 3.5 on average, with vowels and no nine consonants in a row."""
    if len(letters) < 8:
        return True
    vowels = sum(c in "aeiouyAEIOUY" for c in letters)
    humps = HUMP.findall(letters)
    return len(letters) >= 3.5 * len(humps) and min(map(len, humps)) > 1 and 7 * vowels >= len(letters) and not CONSONANTS.search(letters)


class Words:
    """A rule whose letters have to look like words."""

    def __init__(self, pattern: str):
        self.pattern = re.compile(pattern)

    def fullmatch(self, value: str) -> bool:
        return bool(self.pattern.fullmatch(value)) and all(word_like(x) for x in re.findall("[A-Za-z]+", value))


#: Strings that are long and varied, but no secrets.
ALLOWED = (
    ("words only", Words(r"[A-Za-z+/_=-]+")),
    ("digits only", re.compile(r"[0-9+/_=-]+")),
    ("unique identifier", re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")),
    ("words and numbers joined by marks", Words(r"(?:[A-Za-z]++(?<=[a-z]{2})|[A-Z]{1,8}|[0-9]{1,8})(?:[+/_=-]+(?:[A-Za-z]++(?<=[a-z]{2})|[A-Z]{1,8}|[0-9]{1,8}))+")),
    ("word with a number behind", Words(r"[A-Za-z]+[0-9]{1,4}")),
)
TERM = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]


def entropy_spans(candidate: str) -> list[tuple[int, int]]:
    """Spans within a candidate string whose windows reach the threshold of its class."""
    if any(rule.fullmatch(candidate) for _, rule in ALLOWED):
        return []
    least = next((bits for _, chars, bits in CLASSES if chars.fullmatch(candidate)), None)
    if least is None or len(candidate) < WINDOW:
        return []
    limit = WINDOW * (math.log2(WINDOW) - least) + 1e-9  # the sum of c log2 c may not pass it
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for end, char in enumerate(candidate, 1):
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += TERM[c + 1] - TERM[c]
        if end > WINDOW:
            out = candidate[end - WINDOW - 1]
            c = counts[out]
            counts[out] = c - 1
            total += TERM[c - 1] - TERM[c]
        if end >= WINDOW and total <= limit:
            if spans and spans[-1][1] >= end - WINDOW:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((end - WINDOW, end))
    return spans


def secret_runs(candidate: str) -> list[tuple[int, int]]:
    """The runs within a candidate that hold a window over their threshold, whole; none lies within another."""
    runs = {(0, len(candidate)), *(m.span() for run in RUNS for m in run.finditer(candidate))}
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs, key=lambda r: (r[0], -r[1])):
        if (not out or b > out[-1][1]) and entropy_spans(candidate[a:b]):
            out.append((a, b))
    return out


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; places in code points, end exclusive.

    Entropy spans stand beside the base patterns' spans, over the same
    characters too.
    """
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        found += [("entropy", m.start() + a, m.start() + b) for a, b in secret_runs(m[0])]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each maximal run of overlapping spans replaced by ``mark``."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at, stop = [], 0, 0
    for _, start, end in spans:
        if start >= stop:
            out += [text[at:start], mark]
        stop = max(stop, end)
        at = stop
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>: one row per input row, an empty array for null and clean texts.

    Other columns are not read; repeated and null ids are rows like any other.
    An empty text has no spans. A text of any length is scanned whole, in one
    pass per pattern over one text at a time.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets(x.as_py())] for x in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, work, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return scanned.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact_documents(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in ``text_col`` replaced; all rows and columns stay."""
    at = docs.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([redact(x.as_py(), mark) for x in batch.column(at)], pa.string())
        return pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return map_batches(docs.withColumn(text_col, F.col(text_col).cast("string")), work, docs.withColumn(text_col, F.col(text_col).cast("string")).schema)
