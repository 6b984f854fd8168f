"""Numeric examples of single functions on tiny tables."""

import pytest
from pyspark.sql import functions as F

from sceneweave.functions import boxes, scenes, text


def one(spark, column, **values):
    """A column evaluated over one row of values."""
    frame = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()) or "x int")
    return frame.select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    "raw,want",
    [("Yes.", "yes"), ("No, there is not.", "no"), ("The residential area", "residential area"), ("  YEP  ", "yes"), ("three", "3"), ("none", "no"), ("a", ""), ("", ""), (None, ""), ("42.5%\nmore", "42.5"), ("Two red-roofed houses!", "2 red-roofed houses"), ("l'été", "l été")],
)
def test_normalize_answer(spark, raw, want):
    assert one(spark, text.normalize_answer(F.col("t")), t=raw) == want


@pytest.mark.parametrize("pred,gold,want", [("yes", "yes", True), ("there is water present", "water", True), ("waterfall", "water", False), ("x", "", False), (" ".join(["w"] * 12 + ["water"]), "water", False)])
def test_answers_match(spark, pred, gold, want):
    assert one(spark, text.answers_match(F.col("p"), F.col("g")), p=pred, g=gold) is want


BOX = (0.1, 0.2, 0.5, 0.6)


@pytest.mark.parametrize("raw", ["<|box_start|>(100,200),(500,600)<|box_end|>", "{<100><200><500><600>}", '{"bbox_2d": [100, 200, 500, 600]}', "The region is at [100, 200, 500, 600].", "(100,200),(500,600)", "from 100 and 200 to 500 and 600", "[500, 600, 100, 200]"])
def test_box_forms_agree(spark, raw):
    assert tuple(one(spark, boxes.parse_bbox(F.col("t"), "milli"), t=raw)) == pytest.approx(BOX)


@pytest.mark.parametrize("raw", ["no box here", "[100, 200, 100, 600]", "1 2 3", ""])
def test_no_box(spark, raw):
    assert one(spark, boxes.parse_bbox(F.col("t"), "milli"), t=raw) is None


def test_box_scales(spark):
    assert tuple(one(spark, boxes.parse_bbox(F.lit("[0.1, 0.2, 0.5, 0.6]")))) == pytest.approx(BOX)
    assert tuple(one(spark, boxes.parse_bbox(F.lit("[10, 20, 50, 60]")))) == pytest.approx(BOX)
    assert tuple(one(spark, boxes.parse_bbox(F.lit("[200, 400, 1000, 1200]"), "pixel", F.lit(2000), F.lit(2000)))) == pytest.approx(BOX)
    assert tuple(one(spark, boxes.parse_bbox(F.lit("[200, 400, 1000, 2000]"), "auto"))) == pytest.approx((0.1, 0.2, 0.5, 1.0))
    assert one(spark, boxes.normalize_box([F.lit(0.5), F.lit(0.1), F.lit(0.2), F.lit(0.9)])) is None


def test_published_box_to_grid(spark):
    assert one(spark, boxes.milli_box(boxes.parse_published_box(F.lit("[0.64 0.0, 1.0 0.71]")))) == "[640, 0, 1000, 710]"
    assert one(spark, boxes.milli_box(boxes.parse_published_box(F.lit("[0.28 0.33, 0.0 0.8]")))) == "[0, 330, 280, 800]"
    assert one(spark, boxes.parse_published_box(F.lit("north-east"))) is None
    assert one(spark, boxes.milli_box(boxes.box(F.lit(0.0005), F.lit(0.0015), F.lit(0.0025), F.lit(2.0)))) == "[0, 2, 2, 1000]"


def test_iou(spark):
    a, b = boxes.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)), boxes.box(F.lit(0.5), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    none = F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>")
    assert one(spark, boxes.iou(a, b)) == 0.5 and one(spark, boxes.iou(a, none)) == 0.0 and one(spark, boxes.iou(a, none, None)) is None


def test_redaction(spark):
    caption = 'This satellite image, captured in Finland during summer, depicts fields within the "cold, dry" climate zone. Forest is prominent.'
    assert one(spark, text.redact_caption(F.col("c"), F.col("k")), c=caption, k="Finland") == "This satellite image depicts fields. Forest is prominent."
    assert one(spark, text.redact_caption(F.col("c"), F.col("k")), c=caption.replace("Forest", "Finland"), k="Finland") is None
    assert one(spark, text.redact_caption(F.col("c"), F.col("k")), c=caption, k=None) is not None
    assert one(spark, text.redact_caption(F.col("c"), F.col("k")), c="Made in (a.b", k="(a.b") is not None


def test_rewrite_prompt(spark):
    assert one(spark, text.rewrite_prompt(F.lit("Box at <point>(0.82, 0.28)</point> of <ref>a field</ref>, not <point>(0.5, 1)</point>"))) == "Box at (820, 280) of a field, not (500, 1000)"
    assert one(spark, text.rewrite_prompt(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("a,b,want", [("a b c d", "a c d e", 3), ("a", "", 0), ("", "", 0), ("x y x y", "y x y x", 3), ("a b", "c d", 0)])
def test_lcs(spark, a, b, want):
    assert one(spark, text.lcs_length(text.caption_tokens(F.col("a")), text.caption_tokens(F.col("b"))), a=a, b=b) == want


def test_ngrams_of_short_texts(spark):
    assert one(spark, text.ngrams(text.caption_tokens(F.lit("a b")), 3)) == []
    assert one(spark, text.ngrams(text.caption_tokens(F.lit("a b c")), 2)) == ["a b", "b c"]


@pytest.mark.parametrize(
    "query,config,task",
    [("Highlight the river", "single", "grounding"), ("Where is the bridge?", "single", "grounding"), ("Describe this image", "single", "caption"), ("How many ships?", "single", "vqa"), ("", "single", "caption"), ("ships", "single", "vqa"), ("What changed?", "bitemporal_pair", "change_caption"), ("Has it increased?", "bitemporal_pair", "change_vqa"), ("anything", "crossmodal_pair", "crossmodal_vqa")],
)
def test_route(spark, query, config, task):
    assert one(spark, text.route(F.col("q"), F.col("c"))["task"], q=query, c=config) == task


def test_confidence(spark):
    assert one(spark, text.text_confidence(F.lit("yes"))) == 0.84
    assert one(spark, text.text_confidence(F.lit("It is possibly water in the north of it"))) == 0.56
    assert one(spark, text.text_confidence(F.lit("  "))) == 0.05
    got = one(spark, text.agreement(F.lit("no change"), F.lit(0.3), F.lit(None).cast("double"), F.lit(None).cast("double")))
    assert got.adjustment == -0.18 and "30.0%" in got.warning
    assert one(spark, text.agreement(F.lit("fields"), F.lit(None).cast("double"), F.lit(0.5), F.lit(0.2)))["adjustment"] == -0.12


@pytest.mark.parametrize("lon,lat,want", [(72.8, 19.0, 32643), (-58.4, -34.6, 32721), (180.0, 0.0, 32661)])
def test_utm(spark, lon, lat, want):
    assert one(spark, scenes.utm_epsg(F.col("lon"), F.col("lat")), lon=lon, lat=lat) == want


def test_modality_hints(spark):
    of = lambda name, bands=3, dtype="uint8", geo=False: one(spark, scenes.modality(F.lit(name), F.lit(bands), F.lit(dtype), F.lit(geo)))
    assert of("scene_VV.tif") == "sar" and of("panorama.png") == "optical" and of("x.png") == "rgb" and of("x.tif", 1, "float32") == "sar" and of("x.tif", 12) == "optical" and of("x.tif", 1, "uint8", True) == "optical"


def test_change_floor_is_a_ground_area(spark):
    fine, coarse = (one(spark, scenes.change_floor(F.lit(g), F.lit(1024 * 1024))) for g in (0.6, 10.0))
    assert fine == 0.02649095 and coarse == pytest.approx(9.537e-05, abs=1e-8)
    assert one(spark, scenes.change_floor(F.lit(None).cast("double"), F.lit(100))) is None


def test_prompt_needs_its_question(spark):
    assert one(spark, text.render_prompt(F.lit("vqa"), F.lit(" "))) is None
    assert one(spark, text.render_prompt(F.lit("vqa"), F.lit(" Is it? "))).endswith("Question: Is it?\nAnswer:")
    assert one(spark, text.render_prompt(F.lit("caption"), F.lit(None).cast("string"))).startswith("This is")
