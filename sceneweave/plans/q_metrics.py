"""Queries and SQL of answers, boxes and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneweave.functions import boxes, lookup, text
from sceneweave.operators import metrics
from sceneweave.plans.fixtures import view, view_sql

R = lambda c: F.round(c, 6).alias(c.replace("@", "_").replace(".", ""))


def _vqa(spark, sf):
    return metrics.mark_answers(view(spark, sf, "vqa"))


def _boxed(spark, sf):
    b = view(spark, sf, "boxes")
    gold = boxes.normalize_box([F.col(c) for c in ("gx1", "gy1", "gx2", "gy2")], "milli")
    return b.select("sample_id", "raw_text", boxes.parse_bbox(F.col("raw_text"), "milli").alias("predicted"), gold.alias("box"))


def e1_normalize_answer(spark, sf):
    return _vqa(spark, sf).select("sample_id", "norm_pred", "norm_gold")


def e2_answers_match(spark, sf):
    return _vqa(spark, sf).select("sample_id", "hit")


def e3_tokenize(spark, sf):
    t = metrics.tokenized(view(spark, sf, "captions"))
    return t.select("sample_id", "ref", "part", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("long").alias("n"))


def e4_ngrams(spark, sf):
    return metrics.caption_grams(metrics.tokenized(view(spark, sf, "captions"))).groupBy("n", "gram").agg(F.sum("count").alias("times"), F.count_distinct("sample_id").alias("samples"))


def e5_lcs(spark, sf):
    t = metrics.tokenized(view(spark, sf, "captions"))
    c = t.where("part = 'candidate'").select("sample_id", F.col("tokens").alias("a"))
    r = t.where("part = 'reference'").select("sample_id", "ref", F.col("tokens").alias("b"))
    return c.join(r, "sample_id").select("sample_id", "ref", text.lcs_length(F.col("a"), F.col("b")).alias("lcs"))


def e10_parse_bbox(spark, sf):
    b = view(spark, sf, "boxes").select("sample_id", boxes.parse_bbox(F.col("raw_text"), "auto").alias("b"))
    return b.select("sample_id", *[F.round(F.col("b")[k], 6).alias(k) for k in boxes.SIDES])


def e11_rescale(spark, sf):
    b = view(spark, sf, "boxes").select("sample_id", "gx1", "gy1", (F.col("gx2") - F.col("gx1")).alias("w"), (F.col("gy2") - F.col("gy1")).alias("h"))
    box = boxes.normalize_box([F.col(c).cast("double") for c in ("gx1", "gy1", "w", "h")], "auto", xywh=True)
    n = F.col("n")
    return b.select("sample_id", box.alias("n")).select("sample_id", *[F.round(n[k], 6).alias(k) for k in boxes.SIDES])


def e12_iou(spark, sf):
    return _boxed(spark, sf).select("sample_id", F.round(boxes.iou(F.col("predicted"), F.col("box")), 6).alias("iou"))


def e17_text_confidence(spark, sf):
    c = view(spark, sf, "captions")
    return c.select("sample_id", "ref", text.text_confidence(F.col("text")).alias("confidence"))


def h2_hedge_overlap(spark, sf):
    v = view(spark, sf, "vqa")
    words = lookup.HEDGES + lookup.NEGATIVE_WORDS + lookup.POSITIVE_WORDS
    return v.select("sample_id", F.array_join(text.set_overlap(text.plain_tokens(F.col("raw_text")), words), ",").alias("found"))


def h3_reference_ngrams(spark, sf):
    references = metrics.tokenized(view(spark, sf, "captions")).where("part = 'reference'")
    return metrics.by_sample(references, lambda g: g.select("sample_id", "n", "gram").distinct().groupBy("sample_id", "n").agg(F.count("*").alias("grams")))


def f1_vqa_metrics(spark, sf):
    return metrics.vqa_metrics(_vqa(spark, sf)).select(R("oa"), R("aa"), "n")


def f1_vqa_by_type(spark, sf):
    return metrics.type_accuracy(_vqa(spark, sf)).select("qtype", "n", R("accuracy"))


def f2_grounding(spark, sf):
    return metrics.grounding_metrics(_boxed(spark, sf)).select(R("miou"), F.round("`acc@0.25`", 6).alias("acc_025"), F.round("`acc@0.5`", 6).alias("acc_05"), R("parse_rate"), "n")


def f3_bleu(spark, sf):
    return metrics.bleu(view(spark, sf, "captions")).select(*[R(f"bleu{n}") for n in (1, 2, 3, 4)])


def f4_rouge_l(spark, sf):
    return metrics.rouge_l(view(spark, sf, "captions")).select(R("rouge_l"))


def f5_cider_d(spark, sf):
    return metrics.cider_d(view(spark, sf, "captions")).select(R("cider_d"))


def f6_score(spark, sf):
    return metrics.score(view(spark, sf, "vqa"), _boxed(spark, sf), view(spark, sf, "captions")).select("task", "metric", R("value"))


def f16_defect_rates(spark, sf):
    p = view(spark, sf, "predictions")
    return metrics.defect_rates(p, {"truncated": F.col("finish") == "length", "unparsed": F.col("answer").isNull()}, ["model"]).select("model", R("truncated"), R("unparsed"), "n")


def f17_multilabel(spark, sf):
    return metrics.multilabel_metrics(view(spark, sf, "label_scores")).select(R("micro_f1"), R("macro_f1"), R("mean_ap"))


QUERIES = {f.__name__: f for f in [e1_normalize_answer, e2_answers_match, e3_tokenize, e4_ngrams, e5_lcs, e10_parse_bbox, e11_rescale, e12_iou, e17_text_confidence, h2_hedge_overlap, h3_reference_ngrams, f1_vqa_metrics, f1_vqa_by_type, f2_grounding, f3_bleu, f4_rouge_l, f5_cider_d, f6_score, f16_defect_rates, f17_multilabel]}


def _list(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _norm(col):
    numbers = "MAP {" + ", ".join(f"'{w}': '{i}'" for i, w in enumerate(lookup.NUMBER_WORDS)) + "}"
    toks = rf"list_filter(list_transform(string_split_regex(regexp_replace(lower(string_split(trim({col}, chr(32) || chr(9) || chr(10) || chr(13)), chr(10))[1]), '[^\p{{L}}\p{{N}}_\s./%-]', ' ', 'g'), '\s+'), lambda t: trim(t, './-%')), lambda t: t <> '' AND t NOT IN ({_list(lookup.ARTICLES)}))"
    toks = f"list_transform({toks}, lambda t: coalesce(({numbers})[t], t))"
    return f"(SELECT CASE WHEN k[1] IN ({_list(lookup.YES_WORDS)}) THEN 'yes' WHEN k[1] IN ({_list(lookup.NO_WORDS)}) THEN 'no' ELSE coalesce(array_to_string(k, ' '), '') END FROM (SELECT {toks} AS k) z)"


VQA = f"""vqa AS ({view_sql("vqa")}), normed AS (SELECT sample_id, qtype, {_norm("raw_text")} AS p, {_norm("gold")} AS g FROM vqa),
marked AS (SELECT *, CASE WHEN g <> '' AND (p = g OR (len(string_split(p, ' ')) <= 12 AND contains(' ' || p || ' ', ' ' || g || ' '))) THEN 1 ELSE 0 END AS hit FROM normed)"""
NUM = r"(-?\d+(?:\.\d+)?)"


def _raw_box(t):
    forms = [
        rf"<\|box_start\|>\s*\(\s*{NUM}\s*,\s*{NUM}\s*\)\s*,?\s*\(\s*{NUM}\s*,\s*{NUM}\s*\)\s*<\|box_end\|>",
        rf"\{{\s*<\s*{NUM}\s*>\s*<\s*{NUM}\s*>\s*<\s*{NUM}\s*>\s*<\s*{NUM}\s*>\s*\}}",
        rf'"bbox(?:_2d)?"\s*:\s*\[\s*{NUM}\s*,\s*{NUM}\s*,\s*{NUM}\s*,\s*{NUM}\s*\]',
        rf"\[\s*{NUM}\s*,\s*{NUM}\s*,\s*{NUM}\s*,\s*{NUM}\s*\]",
        rf"\(\s*{NUM}\s*,\s*{NUM}\s*\)\s*,\s*\(\s*{NUM}\s*,\s*{NUM}\s*\)",
    ]
    cases = " ".join(f"WHEN regexp_matches({t}, '{f}') THEN [{', '.join(f'CAST(regexp_extract({t}, {chr(39)}{f}{chr(39)}, {g}) AS DOUBLE)' for g in (1, 2, 3, 4))}]" for f in forms)
    return f"CASE {cases} WHEN len(regexp_extract_all({t}, '{NUM}', 1)) >= 4 THEN list_transform(regexp_extract_all({t}, '{NUM}', 1)[1:4], lambda x: CAST(x AS DOUBLE)) END"


def _boxes(scale):
    div = {"milli": "1000.0", "auto": "(CASE WHEN list_max(r) <= 1 THEN 1.0 WHEN list_max(r) <= 100 THEN 100.0 WHEN list_max(r) <= 1000 THEN 1000.0 ELSE list_max(r) END)"}[scale]
    return f"""b AS ({view_sql("boxes")}), raw AS (SELECT *, {_raw_box("raw_text")} AS r FROM b),
s AS (SELECT *, list_transform(r, lambda v: least(greatest(v / {div}, 0.0), 1.0)) AS c FROM raw),
o AS (SELECT *, least(c[1], c[3]) AS x1, least(c[2], c[4]) AS y1, greatest(c[1], c[3]) AS x2, greatest(c[2], c[4]) AS y2 FROM s),
parsed AS (SELECT sample_id, gx1 / 1000.0 AS gx1, gy1 / 1000.0 AS gy1, gx2 / 1000.0 AS gx2, gy2 / 1000.0 AS gy2, (x2 > x1 AND y2 > y1) AS ok, x1, y1, x2, y2 FROM o),
scored AS (SELECT *, CASE WHEN coalesce(ok, FALSE) AND least(x2, gx2) > greatest(x1, gx1) AND least(y2, gy2) > greatest(y1, gy1)
   THEN (least(x2, gx2) - greatest(x1, gx1)) * (least(y2, gy2) - greatest(y1, gy1)) / ((x2 - x1) * (y2 - y1) + (gx2 - gx1) * (gy2 - gy1) - (least(x2, gx2) - greatest(x1, gx1)) * (least(y2, gy2) - greatest(y1, gy1))) ELSE 0.0 END AS iou FROM parsed)"""


CAPTIONS = rf"""caps AS ({view_sql("captions")}), toks AS (SELECT sample_id, ref, part, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda t: t <> '') AS t FROM caps),
raw_grams AS (SELECT sample_id, part, ref, n, unnest(list_transform(range(1, greatest(len(t) - n + 2, 1)), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS gram FROM toks, (SELECT unnest([1, 2, 3, 4]) AS n) k),
grams AS (SELECT sample_id, part, ref, n, gram, count(*) AS c FROM raw_grams GROUP BY ALL)"""
#: The usual table of common subsequences, one row of it per step.
LCS = f"""WITH RECURSIVE {CAPTIONS}, pair AS (SELECT c.sample_id, r.ref, c.t AS a, r.t AS b FROM toks c JOIN toks r ON r.sample_id = c.sample_id AND c.part = 'candidate' AND r.part = 'reference'),
step AS (SELECT sample_id, ref, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS line FROM pair
 UNION ALL SELECT sample_id, ref, a, b, i + 1,
   list_reduce(list_transform(range(1, len(b) + 1), lambda j: [CASE WHEN a[i + 1] = b[j] THEN line[j] + 1 ELSE -1 END, line[j + 1]]), lambda acc, x: list_append(acc, CASE WHEN x[1] >= 0 THEN x[1] ELSE greatest(acc[len(acc)], x[2]) END), [0])
 FROM step WHERE i < len(a)),
lcs AS (SELECT sample_id, ref, len(a) AS la, len(b) AS lb, line[len(line)] AS lcs FROM step WHERE i = len(a))"""
F1 = f"""SELECT round((SELECT avg(hit) FROM marked), 6) AS oa, round(coalesce((SELECT avg(a) FROM (SELECT avg(hit) AS a FROM marked WHERE coalesce(qtype, '') <> '' GROUP BY qtype) t), (SELECT avg(hit) FROM marked)), 6) AS aa, (SELECT count(*) FROM marked) AS n"""
F2 = "SELECT round(avg(iou), 6) AS miou, round(avg(CAST(iou >= 0.25 AS INT)), 6) AS acc_025, round(avg(CAST(iou >= 0.5 AS INT)), 6) AS acc_05, round(avg(CAST(coalesce(ok, FALSE) AS INT)), 6) AS parse_rate, count(*) AS n FROM scored"
BLEU = """best AS (SELECT sample_id, n, gram, max(c) AS m FROM grams WHERE part = 'reference' GROUP BY ALL),
prec AS (SELECT g.n, sum(least(g.c, coalesce(b.m, 0))) / sum(g.c) AS p FROM grams g LEFT JOIN best b USING (sample_id, n, gram) WHERE g.part = 'candidate' GROUP BY g.n),
lens AS (SELECT c.sample_id, len(c.t) AS cl, coalesce(arg_min(len(r.t), abs(len(r.t) - len(c.t)) * 1000000 + len(r.t)), 0) AS rl FROM toks c LEFT JOIN toks r ON r.sample_id = c.sample_id AND r.part = 'reference' WHERE c.part = 'candidate' GROUP BY c.sample_id, c.ref, len(c.t)),
bp AS (SELECT CASE WHEN sum(cl) = 0 THEN 0.0 WHEN sum(cl) < sum(rl) THEN exp(1 - sum(rl) / sum(cl)) ELSE 1.0 END AS f FROM lens),
upto AS (SELECT k.n, CASE WHEN count(*) FILTER (WHERE p > 0) = k.n THEN exp(sum(ln(p)) FILTER (WHERE p > 0) / k.n) ELSE 0.0 END * (SELECT f FROM bp) AS s FROM (SELECT unnest([1, 2, 3, 4]) AS n) k LEFT JOIN prec ON prec.n <= k.n GROUP BY k.n)"""
ROUGE = "best_r AS (SELECT sample_id, max(CASE WHEN lcs > 0 THEN 2.44 * (lcs / la) * (lcs / lb) / (lcs / lb + 1.44 * (lcs / la)) ELSE 0.0 END) AS s FROM lcs GROUP BY sample_id), rouge AS (SELECT coalesce(sum(s), 0.0) / (SELECT count(*) FROM toks WHERE part = 'candidate') AS v FROM best_r)"
CIDER = """total AS (SELECT count(*) AS m FROM toks WHERE part = 'candidate'), df AS (SELECT n, gram, count(DISTINCT sample_id) AS d FROM grams WHERE part = 'reference' GROUP BY n, gram),
wt AS (SELECT g.*, g.c * (ln((SELECT m FROM total)) - ln(greatest(1, coalesce(d, 0)))) AS w FROM grams g LEFT JOIN df USING (n, gram)),
nrm AS (SELECT sample_id, part, ref, n, sqrt(sum(w * w)) AS q FROM wt GROUP BY ALL),
dots AS (SELECT a.sample_id, b.ref, a.n, sum(least(a.w, b.w) * b.w) AS v FROM wt a JOIN wt b ON a.sample_id = b.sample_id AND a.n = b.n AND a.gram = b.gram AND a.part = 'candidate' AND b.part = 'reference' GROUP BY ALL),
vals AS (SELECT d.sample_id, CASE WHEN x.q > 0 AND y.q > 0 THEN v / (x.q * y.q) ELSE v END * exp(-((len(c.t) - len(r.t)) * (len(c.t) - len(r.t))) / 72.0) AS v FROM dots d
 JOIN nrm x ON x.sample_id = d.sample_id AND x.n = d.n AND x.part = 'candidate' JOIN nrm y ON y.sample_id = d.sample_id AND y.n = d.n AND y.part = 'reference' AND y.ref = d.ref
 JOIN toks c ON c.sample_id = d.sample_id AND c.part = 'candidate' JOIN toks r ON r.sample_id = d.sample_id AND r.ref = d.ref AND r.part = 'reference'),
cid AS (SELECT coalesce(sum(10.0 * s / (4 * k)), 0.0) / (SELECT m FROM total) AS v FROM (SELECT sample_id, sum(v) AS s FROM vals GROUP BY sample_id) a JOIN (SELECT sample_id, count(*) AS k FROM toks WHERE part = 'reference' GROUP BY sample_id) b USING (sample_id))"""
PLAIN = lambda c: f"list_distinct(list_transform(list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> ''), lambda t: lower(trim(t, '.,;:!?'))))"

SQL = {
    "e1_normalize_answer": f"WITH {VQA} SELECT sample_id, p AS norm_pred, g AS norm_gold FROM marked",
    "e2_answers_match": f"WITH {VQA} SELECT sample_id, hit FROM marked",
    "e3_tokenize": f"WITH {CAPTIONS} SELECT sample_id, ref, part, array_to_string(t, ' ') AS tokens, len(t) AS n FROM toks",
    "e4_ngrams": f"WITH {CAPTIONS} SELECT n, gram, CAST(sum(c) AS BIGINT) AS times, count(DISTINCT sample_id) AS samples FROM grams GROUP BY n, gram",
    "e5_lcs": f"{LCS} SELECT sample_id, ref, CAST(lcs AS INTEGER) AS lcs FROM lcs",
    "e10_parse_bbox": f"WITH {_boxes('auto')} SELECT sample_id, CASE WHEN ok THEN round(x1, 6) END AS x1, CASE WHEN ok THEN round(y1, 6) END AS y1, CASE WHEN ok THEN round(x2, 6) END AS x2, CASE WHEN ok THEN round(y2, 6) END AS y2 FROM parsed",
    "e11_rescale": f"""WITH b AS ({view_sql("boxes")}), d AS (SELECT *, CASE WHEN greatest(gx1, gy1, gx2, gy2) <= 1 THEN 1.0 WHEN greatest(gx1, gy1, gx2, gy2) <= 100 THEN 100.0 WHEN greatest(gx1, gy1, gx2, gy2) <= 1000 THEN 1000.0 ELSE greatest(gx1, gy1, gx2, gy2) END AS k FROM b)
SELECT sample_id, round(CAST(gx1 AS DOUBLE) / k, 6) AS x1, round(CAST(gy1 AS DOUBLE) / k, 6) AS y1, round(least(CAST(gx2 AS DOUBLE) / k, 1.0), 6) AS x2, round(least(CAST(gy2 AS DOUBLE) / k, 1.0), 6) AS y2 FROM d""",
    "e12_iou": f"WITH {_boxes('milli')} SELECT sample_id, round(iou, 6) AS iou FROM scored",
    "e17_text_confidence": f"""WITH caps AS ({view_sql("captions")}), k AS (SELECT sample_id, ref, text, {PLAIN("text")} AS t FROM caps)
SELECT sample_id, ref, CASE WHEN trim(text) = '' THEN 0.05 ELSE round_even(least(greatest(0.78 - CASE WHEN list_has_any(t, [{_list(lookup.HEDGES)}]) THEN 0.22 ELSE 0 END + CASE WHEN len(t) > 60 THEN -0.08 WHEN len(t) <= 3 THEN 0.06 ELSE 0 END, 0.05), 0.92)::DOUBLE, 3) END AS confidence FROM k""",
    "h2_hedge_overlap": f"""WITH v AS ({view_sql("vqa")}) SELECT sample_id, coalesce(array_to_string(list_sort(list_intersect({PLAIN("raw_text")}, [{_list(lookup.HEDGES + lookup.NEGATIVE_WORDS + lookup.POSITIVE_WORDS)}])), ','), '') AS found FROM v""",
    "h3_reference_ngrams": f"WITH {CAPTIONS} SELECT sample_id, CAST(n AS INTEGER) AS n, count(DISTINCT gram) AS grams FROM grams WHERE part = 'reference' GROUP BY sample_id, n",
    "f1_vqa_metrics": f"WITH {VQA} {F1}",
    "f1_vqa_by_type": f"WITH {VQA} SELECT qtype, count(*) AS n, round(avg(hit), 6) AS accuracy FROM marked WHERE coalesce(qtype, '') <> '' GROUP BY qtype UNION ALL SELECT NULL, count(*), round(avg(hit), 6) FROM marked",
    "f2_grounding": f"WITH {_boxes('milli')} {F2}",
    "f3_bleu": f"WITH {CAPTIONS}, {BLEU} SELECT round(max(s) FILTER (WHERE n = 1), 6) AS bleu1, round(max(s) FILTER (WHERE n = 2), 6) AS bleu2, round(max(s) FILTER (WHERE n = 3), 6) AS bleu3, round(max(s) FILTER (WHERE n = 4), 6) AS bleu4 FROM upto",
    "f4_rouge_l": f"{LCS}, {ROUGE} SELECT round(v, 6) AS rouge_l FROM rouge",
    "f5_cider_d": f"WITH {CAPTIONS}, {CIDER} SELECT round(v, 6) AS cider_d FROM cid",
    "f6_score": f"""{LCS}, {VQA}, {_boxes("milli")}, {BLEU}, {ROUGE}, {CIDER}, one AS ({F1}), two AS ({F2})
SELECT 'vqa' AS task, 'oa' AS metric, oa AS value FROM one UNION ALL SELECT 'vqa', 'aa', aa FROM one UNION ALL SELECT 'vqa', 'n', CAST(n AS DOUBLE) FROM one
UNION ALL SELECT 'grounding', 'miou', miou FROM two UNION ALL SELECT 'grounding', 'acc@0.25', acc_025 FROM two UNION ALL SELECT 'grounding', 'acc@0.5', acc_05 FROM two UNION ALL SELECT 'grounding', 'parse_rate', parse_rate FROM two UNION ALL SELECT 'grounding', 'n', CAST(n AS DOUBLE) FROM two
UNION ALL SELECT 'caption', 'bleu' || n, round(s, 6) FROM upto UNION ALL SELECT 'caption', 'rouge_l', round(v, 6) FROM rouge UNION ALL SELECT 'caption', 'cider_d', round(v, 6) FROM cid""",
    "f16_defect_rates": f"WITH p AS ({view_sql('predictions')}) SELECT model, round(avg(CAST(finish = 'length' AS INT)), 6) AS truncated, round(avg(CAST(answer IS NULL AS INT)), 6) AS unparsed, count(*) AS n FROM p GROUP BY model",
    "f17_multilabel": f"""WITH s AS ({view_sql("label_scores")}), c AS (SELECT label, sum(truth) FILTER (WHERE score >= 0.5) AS tp, count(*) FILTER (WHERE score >= 0.5 AND truth = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND truth = 1) AS fn FROM s GROUP BY label),
r AS (SELECT label, truth, sum(truth) OVER w AS t, count(*) OVER w AS k FROM s WINDOW w AS (PARTITION BY label ORDER BY score DESC, sample_id ROWS UNBOUNDED PRECEDING))
SELECT round((SELECT 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) FROM c), 6) AS micro_f1, round((SELECT avg(2 * coalesce(tp, 0) / (2 * coalesce(tp, 0) + fp + fn)) FROM c), 6) AS macro_f1,
 round((SELECT avg(a) FROM (SELECT avg(t / k) AS a FROM r WHERE truth = 1 GROUP BY label) q), 6) AS mean_ap""",
}
