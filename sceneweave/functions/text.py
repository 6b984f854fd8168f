"""Text expressions: answers, captions, prompts, routing, lexical confidence.

All are columns in, columns out, and stay in the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sceneweave.functions import lookup


def words_in(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def first_line(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), r"\r\n|[\n\r\x0B\f\x1c-\x1e\u0085  ]").getItem(0)


def normalize_answer(text: Column) -> Column:
    """First line in lower case without punctuation and articles; number words as digits; yes and no words folded.

    "none" becomes "no", and the answer "a" becomes empty. Null gives an empty string.
    """
    plain = F.regexp_replace(F.lower(first_line(text)), r"[^\p{L}\p{N}_\s./%-]", " ")
    tokens = F.transform(F.split(plain, r"\s+"), lambda t: F.btrim(t, F.lit("./-%")))
    tokens = F.filter(tokens, lambda t: (t != "") & ~t.isin(lookup.ARTICLES))
    numbers = F.create_map(*[F.lit(x) for i, w in enumerate(lookup.NUMBER_WORDS) for x in (w, str(i))])
    tokens = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(numbers, t), t))
    head = F.try_element_at(tokens, F.lit(1))
    return F.when(head.isin(lookup.YES_WORDS), "yes").when(head.isin(lookup.NO_WORDS), "no").otherwise(F.array_join(tokens, " "))


def answers_match(prediction: Column, reference: Column) -> Column:
    """Both already normalised: equal, or a prediction of few words that has the reference as whole words. An empty reference never matches."""
    few = F.size(F.split(prediction, " ")) <= lookup.ANSWER_WORD_LIMIT
    within = F.contains(F.concat(F.lit(" "), prediction, F.lit(" ")), F.concat(F.lit(" "), reference, F.lit(" ")))
    return (reference != "") & ((prediction == reference) | (few & within))


def caption_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda t: t != "")


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams as strings joined by spaces; empty for shorter texts."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: i <= F.size(tokens) - (n - 1))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays.

    A nested aggregate can say this too, but it builds an array per token and
    took twenty times as long on captions of some hundred words. Here each token of ``b``
    is a few operations on one integer with a bit per token of ``a``.
    """
    out = []
    for left, right in zip(a, b, strict=True):
        if left is None or right is None or not len(left) or not len(right):
            out.append(0)
            continue
        places: dict[str, int] = {}
        for i, token in enumerate(left):
            places[token] = places.get(token, 0) | 1 << i
        full = (1 << len(left)) - 1
        open_places = full
        for token in right:
            met = open_places & places.get(token, 0)
            open_places = ((open_places + met) | (open_places - met)) & full
        out.append(len(left) - open_places.bit_count())
    return pd.Series(out, dtype="int32")


def redact_caption(caption: Column, country: Column) -> Column:
    """The caption without climate-zone and capture clauses; null if it is empty or still names the country."""
    text = F.regexp_replace(caption, r'(?i)\s*(?:with)?in the\s*"[^"]*"\s*climate zone', "")
    text = F.regexp_replace(text, r"(?i),\s*captured[^,]*,\s*", " ")
    text = F.trim(F.regexp_replace(text, r"\s{2,}", " "))
    text = F.regexp_replace(text, r"\s+([,.])", "$1")
    names = F.regexp_like(text, F.concat(F.lit(r"(?i)\b\Q"), country, F.lit(r"\E\b")))
    return F.when((text != "") & ~F.coalesce((country != "") & names, F.lit(False)), text)


def milli(value: Column) -> Column:
    return F.bround(value * 1000).cast("long")


def rewrite_prompt(text: Column) -> Column:
    """<point>(x, y)</point> with unit numbers becomes (1000x, 1000y); <ref> marks go."""
    number = r"([-+0-9.eE]+)"
    point = rf"<point>\s*\(\s*{number}\s*,\s*{number}\s*\)\s*</point>"
    text = F.coalesce(text, F.lit(""))
    parts = F.split(text, rf"<point>\s*\(\s*[-+0-9.eE]+\s*,\s*[-+0-9.eE]+\s*\)\s*</point>")
    xs, ys = F.regexp_extract_all(text, F.lit(point), F.lit(1)), F.regexp_extract_all(text, F.lit(point), F.lit(2))
    points = F.zip_with(xs, ys, lambda x, y: F.concat(F.lit("("), milli(x.try_cast("double")), F.lit(", "), milli(y.try_cast("double")), F.lit(")")))
    woven = F.array_join(F.zip_with(parts, points, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return F.trim(F.regexp_replace(woven, "</?ref>", ""))


def turn_text(value: Column) -> Column:
    """A user turn without its "Image N: <image>" lines."""
    lines = F.filter(F.split(F.coalesce(value, F.lit("")), "\n"), lambda x: ~F.regexp_like(x, F.lit(r"(?i)^\s*Image\s+\d+\s*:\s*<image>\s*$")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def render_prompt(task: Column, question: Column) -> Column:
    """The task's prompt; null where a task needs a question and has none."""
    asked = F.trim(question)
    out = F.lit(None).cast("string")
    for name, template in lookup.PROMPTS.items():
        filled = F.when(asked != "", F.replace(F.lit(template), F.lit("{question}"), asked)) if "{question}" in template else F.lit(template)
        out = F.when(task == name, filled).otherwise(out)
    return out


def token_budget(task: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, (_, budget) in lookup.TASKS.items():
        out = F.when(task == name, budget).otherwise(out)
    return out


def input_config(task: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (config, _) in lookup.TASKS.items():
        out = F.when(task == name, config).otherwise(out)
    return out


def evidence_preamble(values: dict[str, Column], again: Column | None = None) -> Column:
    """Header and one line per value that is not null, in the fixed order; empty without values."""
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"- {label}: "), values[key].cast("string")) for key, label in lookup.EVIDENCE_LABELS.items() if key in values])
    header = F.lit(lookup.EVIDENCE_HEADER) if again is None else F.when(again, lookup.EVIDENCE_HEADER_AGAIN).otherwise(lookup.EVIDENCE_HEADER)
    return F.when(lines != "", F.concat(header, F.lit("\n"), lines)).otherwise("")


def any_match(text: Column, patterns: list[str]) -> Column:
    """The first pattern that the text matches, or null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(p)) for p in patterns])


def route(query: Column, config: Column) -> Column:
    """struct<task, rule, confidence> by input configuration first, then by pattern groups in order."""
    text = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    question = any_match(text, lookup.QUESTION_PATTERNS)
    change = any_match(text, lookup.CHANGE_CAPTION_PATTERNS)
    grounding = any_match(text, lookup.GROUNDING_PATTERNS)
    caption = any_match(text, lookup.CAPTION_PATTERNS)

    def to(task: str, rule: Column | str, confidence: float) -> Column:
        return F.struct(F.lit(task).alias("task"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), F.lit(confidence).alias("confidence"))

    pair = config == "bitemporal_pair"
    return (
        F.when(config == "crossmodal_pair", to("crossmodal_vqa", "input_config=crossmodal_pair", 1.0))
        .when(pair & (text == ""), to("change_caption", "bitemporal + empty query", 0.9))
        .when(pair & change.isNotNull() & question.isNull(), to("change_caption", F.concat(F.lit("bitemporal + "), change), 0.85))
        .when(pair, to("change_vqa", "bitemporal + question", 0.9))
        .when(text == "", to("caption", "single + empty query", 0.9))
        .when(grounding.isNotNull(), to("grounding", F.concat(F.lit("single + "), grounding), 0.9))
        .when(caption.isNotNull() & question.isNull(), to("caption", F.concat(F.lit("single + "), caption), 0.85))
        .when(question.isNotNull(), to("vqa", F.concat(F.lit("single + "), question), 0.9))
        .when(text.endswith("?"), to("vqa", "single + question mark", 0.75))
        .otherwise(to("vqa", "single + default", 0.6))
    )


def plain_tokens(text: Column) -> Column:
    """Distinct words in lower case, without marks at their edges."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    return F.array_distinct(F.transform(tokens, lambda t: F.lower(F.btrim(t, F.lit(".,;:!?")))))


def bounded(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(lookup.CONFIDENCE_FLOOR)), F.lit(lookup.CONFIDENCE_CEILING))


def text_confidence(text: Column) -> Column:
    """0.78, less for hedges and for long answers, more for up to three words, within bounds; the floor for blank text."""
    tokens = plain_tokens(text)
    hedge = F.when(F.arrays_overlap(tokens, words_in(lookup.HEDGES)), -0.22).otherwise(0.0)
    length = F.when(F.size(tokens) > 60, -0.08).when(F.size(tokens) <= 3, 0.06).otherwise(0.0)
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "") == ""
    return F.when(blank, lookup.CONFIDENCE_FLOOR).otherwise(F.bround(bounded(F.lit(0.78) + hedge + length), 3))


def rounded(value: Column, places: int) -> Column:
    """A double to so many places as SQL and C round it: the scaled double decides, where ``round`` looks at its shortest decimal text (0.0020475 is below 0.0020475 and gives 0.002047)."""
    scale = float(10**places)
    return F.round(value * scale) / scale


def fixed(value: Column, places: int) -> Column:
    """A double as text with so many places, by its binary value; null for null."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def percent(value: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", F.bround(value * 100, places))


def agreement(answer: Column, changed: Column, sar_water: Column, optical_water: Column) -> Column:
    """struct<adjustment, warning>: an answer against measured change, else water from two sensors against each other."""
    tokens = plain_tokens(answer)
    nothing, something = F.arrays_overlap(tokens, words_in(lookup.NEGATIVE_WORDS)), F.arrays_overlap(tokens, words_in(lookup.POSITIVE_WORDS))
    gap = F.abs(sar_water - optical_water)

    def of(value: float, warning: Column | None = None) -> Column:
        return F.struct(F.lit(value).alias("adjustment"), (F.lit(None).cast("string") if warning is None else warning).alias("warning"))

    return (
        F.when(nothing & (changed > lookup.LOUD_CHANGE), of(-0.18, F.concat(F.lit("the answer reports no change, but the change mask covers "), percent(changed), F.lit(" of the scene"))))
        .when(something & (changed < lookup.QUIET_CHANGE), of(-0.15, F.concat(F.lit("the answer reports change, but the change mask covers only "), percent(changed), F.lit(" of the scene"))))
        .when((nothing & (changed < lookup.QUIET_CHANGE)) | (something & (changed > lookup.QUIET_CHANGE)), of(0.10))
        .when(gap > lookup.WATER_GAP, of(-0.12, F.concat(F.lit("optical and SAR disagree on water extent ("), percent(optical_water), F.lit(" vs "), percent(sar_water), F.lit("); cloud or shadow is likely"))))
        .when(gap.isNotNull(), of(0.08))
        .otherwise(of(0.0))
    )


def closed_question(query: Column) -> Column:
    return F.regexp_like(F.coalesce(query, F.lit("")), F.lit("(?i)" + lookup.CLOSED_QUESTION))


def generation_budget(task: Column, query: Column) -> Column:
    """struct<tokens, reason>: how long an answer the request calls for."""
    of = lambda n, why: F.struct(F.lit(n).alias("tokens"), F.lit(why).alias("reason"))
    return (
        F.when(task.isin("caption", "change_caption"), of(200, "description task; two sentences plus headroom"))
        .when(task == "grounding", of(64, "grounding; enough for a box, no prose"))
        .when(task == "crossmodal_vqa", of(128, "cross-modal answer must report two quantities from two sensors"))
        .when(closed_question(query), of(24, "closed question; a short answer scores better under exact match"))
        .otherwise(of(64, "open question; a phrase or short sentence"))
    )


def echo_answer(prompt: Column) -> Column:
    """The deterministic stand-in for a model."""
    low = F.lower(F.coalesce(prompt, F.lit("")))
    return F.when(F.contains(low, F.lit("bounding box")), lookup.ECHO_BOX).when(F.contains(low, F.lit("describe")), lookup.ECHO_CAPTION).otherwise(lookup.ECHO_YES)


def clean_qtype(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def resolve_image(name: Column, root: str, suffix: str = "") -> Column:
    """root/name with the suffix put on once; the name alone without a root."""
    named = F.when(name.endswith(suffix), name).otherwise(F.concat(name, F.lit(suffix))) if suffix else name
    return F.concat(F.lit(root.rstrip("/") + "/"), named) if root else named


def config_hash(columns: list[Column]) -> Column:
    """First 12 hex digits of the SHA-256 of a JSON object of the columns, which should be in order of their names."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 12)


def model_slug(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("__"))


def trace_json(columns: list[Column]) -> Column:
    return F.to_json(F.struct(*columns))


def set_overlap(tokens: Column, values: list[str]) -> Column:
    return F.array_sort(F.array_intersect(tokens, words_in(values)))


