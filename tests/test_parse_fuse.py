import json

import numpy as np
from pyspark.sql import functions as F

from dashgrid.operators import fuse, ladder
from dashgrid.operators.parse import anchor_for, parse_lines
from tests.test_raster import render

LINES = "array<struct<text:string,left:int,top:int,right:int,bottom:int,confidence:float>>"


def parse(spark, *lines):
    rows = [(1, [(t, *box, None) for t, box in lines])]
    r = parse_lines(spark.createDataFrame(rows, f"id int, lines {LINES}"), "lines").first()
    return r.odo, r.battery, r.range, " / ".join(r.notes)


def row(i, x=0, w=120, h=30):
    return (x, i * 60, x + w, i * 60 + h)


#: Layouts and what they must give (odo, battery, range; None for nothing, ... for anything), and a part of the notes.
GOLDEN = {
    "merged": ((12676, 84, 91), "merged", "ODO 12,676 km|40 60 320 110;62|500 300 700 480;BATTERY 84%|812 96 1040 150;RANGE 91 km|820 200 1030 250"),
    "stacked": ((12676, 84, 91), "", "ODO|40 60 140 100;12,676 km|40 105 260 150;62|500 300 700 480;BATTERY|812 60 1000 100;84%|830 105 930 150;RANGE|812 200 980 240;91 km|830 245 940 290"),
    "no range": ((12676, 84, None), "range: no anchor found", "ODO 12,676 km|40 60 320 110;BATTERY 84%|812 96 1040 150"),
    "speed trap": ((None, 84, 91), "no ODO anchor", "62|500 300 700 480;BATTERY 84%|812 96 1040 150;RANGE 91 km|820 200 1030 250"),
    "beside": ((12676, ..., ...), "", "ODO|40 60 140 100;12676|160 62 300 102;88|600 40 800 220;BATTERY 84%|812 96 1040 150;RANGE 91 km|820 200 1030 250"),
    "misread label": ((12676, 99, 99), "OCR-tolerant", "08:11|1300 370 1470 400;BATTERY|1240 470 1470 515;99%|1350 540 1490 600;000 km|215 505 390 545;12676|215 560 430 610;00|680 500 980 780;km/h|790 790 880 820;"
                      "TRIP km|215 680 390 720;0|215 745 250 790;RANGE km|1240 660 1480 700;99|1390 720 1470 770;PARKED|700 880 960 930"),
    "bare percent": ((0, 0, 0), "standalone percentage", "06:17 PM|500 378 585 398;ODO|155 505 195 522;0.0 KM|155 535 260 562;CURRENT RIDE|152 595 295 615;0.0 KM 0 MIN|152 630 320 655;AVG. SPEED|152 690 275 710;0 KM/H|152 722 230 745;"
                     "0|505 555 590 660;KM/H|520 695 575 715;ESTIMATED RANGE|712 540 890 562;0%|712 648 745 665;0 KM|815 580 925 665;PARK ASSIST|150 835 295 858"),
    "lone value": ((0, None, 0), "lone", "0.0 lm|151 536 237 557;CURRENT RIDE|161 589 292 614;O.0 ken O min|152 628 318 652;AVe. SPEED|154 689 275 705;PARK ASSIsT|150 828 295 859;0617 PM|499 377 583 398;km/h|518 693 574 712;"
                   "eSTIMATED RANGE|713 540 888 559;RIDE|763 705 838 732;0.|854 578 901 662;km|883 635 923 655"),
    "far side": ((0, None, None), "", "O.0 lem|301 1071 472 1112;cURRENT RIDE >|304 1187 632 1221;0.0 len 0 min|305 1261 638 1303;AVe. SPEED|309 1379 551 1411;PARK ASSIST|299 1668 595 1711;o617 PM|999 755 1165 793;km/h|1035 1390 1152 1427;"
                 "eSTIMATED RANGE|1427 1086 1779 1120;km|1766 1270 1847 1313;RIDE S|1526 1400 1797 1473"),
    "decimal": ((123, ..., ...), "", "ODO|155 505 195 522;123.4 KM|155 535 280 562"),
    "out of range": ((12676, None, 91), "", "ODO 12,676 km|40 60 320 110;BATTERY 470%|812 96 1040 150;RANGE 91 km|820 200 1030 250"),
    "fuzzy": ((12676, 84, 91), "", "0D0|40 60 140 100;12676|40 105 260 150;8ATTERY|812 60 1000 100;84%|830 105 930 150;RNGE km|812 200 980 240;91|830 245 940 290"),
    "letters": ((12941, 10, 11), "", "ODO km|215 505 390 545;L2941|215 560 430 610;BATTERY|1240 470 1470 515;1O%|1350 540 1450 600;RANGE km|1240 660 1480 700;1I|1390 720 1470 770"),
    "no digit": ((..., None, ...), "", "BATTERY|1240 470 1470 515;S|1350 540 1400 600"),
    "two zeros": ((None, 10, ...), "", "00|500 300 700 480;12941|205 555 430 610;BATTERY 10%|1240 470 1470 515"),
    "long line": ((None, 100, 155), "", "Kample+live+with+ODO%2C+battery %2 C+...&sca_esy=140&udm=2&bi...|-3 20 1132 215;IO:07|407 636 481 663;TOTAL km|399 693 541 722;TRIP km|403 806 523 832;CAN ERRORS|580 638 850 674;00|601 694 836 886;"
                  "PARKED|639 923 797 960;BATTERY|895 691 1029 720;I00|966 726 1048 764;RANGE km|891 806 1028 830;IS5|965 839 1028 875"),
    "split digits": ((7612, ..., ...), "", "TOTAL km|399 693 541 722;76 12|410 730 545 790;TRIP km|403 806 523 832;0.0|410 840 470 880"),
    "one line, one field": ((..., 91, None), "", "BATTERY|812 60 1000 100;RANGE|812 200 980 240;91|830 245 940 290"),
}


def test_golden_layouts(spark):
    rows = [(name, [(t, *map(int, box.split()), None) for t, box in (x.split("|") for x in text.split(";"))]) for name, (_, _, text) in GOLDEN.items()]
    for r in parse_lines(spark.createDataFrame(rows, f"name string, lines {LINES}"), "lines").collect():
        want, part, _ = GOLDEN[r.name]
        got = (r.odo, r.battery, r.range)
        if r.name == "one line, one field":
            assert [x for x in got[1:] if x is not None] == [91]
            continue
        assert all(w is ... or w == g for w, g in zip(want, got)), (r.name, got)
        assert part in " / ".join(r.notes) and "KAMPLE" not in " / ".join(r.notes), r.notes


def test_lone_percentages(spark):
    assert parse(spark, ("470%", row(0)), ("84%", row(3)))[1] is None              # two lines of the form, whatever their values
    assert "ambiguous" in parse(spark, ("470%", row(0)), ("84%", row(3)))[3]
    assert parse(spark, ("010 %", row(0)))[1] is None                              # the line anchors the odometer
    assert parse(spark, ("84%\u00a0", row(0)))[1] == 84 and parse(spark, ("\u300084%", row(0)))[1] == 84


def test_merged_lines(spark):
    odo, battery, range_, notes = parse(spark, ("Odo 12676 km", row(0)), ("BATTERY 84%", row(1)), ("Range 91 km", row(2)))
    assert (odo, battery, range_) == (12676, 84, 91) and "merged" in notes


def test_stacked_lines(spark):
    got = parse(spark, ("ODO", row(0)), ("12676 KM", (0, 35, 120, 60)), ("BATTERY", (300, 0, 420, 30)), ("84 %", (300, 35, 420, 60)), ("RANGE", (600, 0, 720, 30)), ("91", (600, 35, 720, 60)))
    assert got[:3] == (12676, 84, 91)


def test_speed_never_becomes_odo(spark):
    odo, battery, _, notes = parse(spark, ("47", (0, 0, 400, 300)), ("BATTERY 84%", row(8)))
    assert odo is None and battery == 84 and "no ODO anchor" in notes


def test_misread_label_and_repair(spark):
    assert parse(spark, ("0D0 L2941 km", row(0)))[0] == 12941
    assert parse(spark, ("BATT LO%", row(0)))[1] is None
    assert parse(spark, ("00", row(0)), ("10 %", row(3)))[:2] == (None, 10)


def test_standalone_values(spark):
    odo, battery, _, notes = parse(spark, ("0 KM", row(0)), ("0 %", row(3)))
    assert (odo, battery) == (0, 0) and "lone" in notes and "standalone percentage" in notes
    assert parse(spark, ("10 %", row(0)), ("20 %", row(3)))[1] is None


def test_one_line_feeds_one_field(spark):
    got = parse(spark, ("BATTERY", (0, 0, 100, 30)), ("RANGE", (110, 0, 210, 30)), ("91", (60, 35, 150, 60)))
    assert sorted(x is not None for x in got[1:3]) == [False, True]


def test_empty_and_null_lines(spark):
    assert parse(spark)[:3] == (None, None, None)
    d = spark.createDataFrame([(1, None)], f"id int, lines {LINES}")
    assert parse_lines(d, "lines").first().odo is None
    assert parse_lines(d.where("id > 1"), "lines").count() == 0


def merge(spark, field, a, b, conf=(None, None), last=None, names=("mlkit", "paddle")):
    d = spark.createDataFrame([(a, b, *conf, last)], "a int, b int, ca float, cb float, last int")
    out = fuse.ensemble_field(field, F.col("a"), F.col("b"), F.lit(names[0]), F.lit(names[1]), F.col("ca"), F.col("cb"), F.col("last"))
    r = d.select(out.alias("o")).first().o
    return r.value, r.confidence, r.engine, r.tiebreak


def test_ensemble_decisions(spark):
    assert merge(spark, "odo", 12676, 12676) == (12676, "HIGH", "both", None)
    assert merge(spark, "battery", None, 84) == (84, "MEDIUM", "paddle", None)
    assert merge(spark, "battery", None, None) == (None, None, None, None)
    assert merge(spark, "battery", 470, 84) == (84, "LOW", "paddle", "sanity check")
    assert merge(spark, "odo", 1272, 12728, last=12676) == (12728, "LOW", "paddle", "sanity check")
    assert merge(spark, "range", 911, 91)[0] == 91
    assert merge(spark, "battery", 84, 64, conf=(0.95, 0.55)) == (84, "LOW", "mlkit", "higher OCR confidence")
    assert merge(spark, "battery", 84, 64) == (64, "LOW", "paddle", "engine preference")
    assert merge(spark, "battery", 470, 300) == (300, "LOW", "paddle", "engine preference")
    assert merge(spark, "battery", 84, 64, names=("a", "b")) == (84, "LOW", "a", "primary engine fallback")
    assert merge(spark, "odo", 5, 2_147_483_647, last=2_147_483_000)[0] == 2_147_483_647


def test_line_confidence(spark):
    d = spark.createDataFrame([([("12676 km", 0, 0, 0, 0, 0.5), ("x 12,676", 0, 0, 0, 0, 0.75), ("9", 0, 0, 0, 0, float("nan")), ("12676", 0, 0, 0, 0, None)],)], f"lines {LINES}")
    get = lambda v: d.select(fuse.line_confidence(F.lit(v), F.col("lines")).alias("c")).first().c
    assert get(12676) == 0.75 and get(9) is None and get(555) is None


def test_fill_empty_and_ladder(spark):
    s = "struct<odo:int,battery:int,range:int,lines:" + LINES + ",notes:array<string>>"
    d = spark.createDataFrame([((12676, None, 99, [], []), (None, 84, 91, [], []))], f"a {s}, b {s}")
    m = d.select(fuse.fill_empty(F.col("a"), F.col("b"), "crop").alias("m")).first().m
    assert (m.odo, m.battery, m.range) == (12676, 84, 99) and m.notes == ["battery: recovered by crop"] and m.lines == []
    one = [("ODO 12676", 0, 0, 100, 20, None)]
    d = spark.createDataFrame([((12676, None, 99, one, ["odo: merged"]), (None, 84, 91, one, ["battery: lone"]))], f"a {s}, b {s}")
    m = d.select(fuse.fill_empty(F.col("a"), F.col("b"), "pass2 (high-res)").alias("m")).first().m
    assert m.notes == ["odo: merged", "battery: recovered by pass2 (high-res)", "pass2 (high-res): battery: lone"] and [x.text for x in m.lines] == ["ODO 12676", "— pass2 (high-res) —", "ODO 12676"]
    obs = spark.createDataFrame([("i", 2, 7, 50, None), ("i", 1, None, 40, None), ("i", 3, 9, 9, 9)], "image string, rung_no int, odo int, battery int, range int")
    r = fuse.ladder(obs, ["image"]).first()
    assert (r.odo, r.battery, r.range, r.odo_rung, r.battery_rung, r.range_rung) == (7, 40, 9, 2, 1, 3)
    e = {x.rung_no: x for x in fuse.ladder_events(obs, ["image"]).collect()}
    assert e[1].accepted == ["battery"] and e[2].accepted == ["odo"] and e[2].discarded == ["battery"] and e[3].accepted == ["range"]


OBS = f"k int, ord int, rung string, engine string, variant string, odo int, battery int, range int, lines {LINES}, notes array<string>, confidence map<string,string>, engines array<string>, remarks array<string>"
LINE = [("84%", 0, 0, 1, 1, None)]


def test_ladder_run(spark):
    rows = [(1, 0, "pass1-ensemble", "both", "ORIGINAL", None, None, 91, LINE, ["mlkit: range: x"], {"range": "HIGH"}, ["mlkit", "paddle"], ["range: agree \"91\"\n"]),
            (1, 1, "retry-highres", "paddle", "ORIGINAL", None, 84, 5, LINE, ["battery: y"], None, None, None),
            (1, 2, "crop", "paddle", "CLAHE_STRETCH", None, None, None, [], [], None, None, ["display warp: applied"]),
            (1, 3, "anchor-region", "7seg", "crop", 12676, 3, None, LINE, ["odo: z"], None, None, None),
            (1, 4, "segment-decode", "7seg", "ORIGINAL", 1, 1, 1, LINE, [], None, None, None),
            (2, 0, "pass1", "mlkit", "ORIGINAL", None, None, None, None, None, None, None, None), (2, 1, "anchor-region", "7seg", "ORIGINAL", None, None, None, None, [], None, None, None)]
    got = {r.k: r for r in ladder.ladder_run(spark.createDataFrame(rows, OBS), ["k"]).collect()}
    a = got[1]
    assert (a.odo, a.battery, a.range) == (12676, 84, 91) and [(e.rung, e.produced, e.accepted) for e in a.rungEvents] == [
        ("pass1-ensemble", ["range"], ["range"]), ("retry-highres", ["battery", "range"], ["battery"]), ("anchor-region", ["odo"], ["odo"])]
    assert a.sources == {"range": "91 ← both / ORIGINAL / pass1-ensemble [HIGH]", "battery": "84 ← paddle / ORIGINAL / retry-highres", "odo": "12676 ← 7seg / crop / anchor-region"}
    assert a.notes[:4] == ["mlkit: range: x", "battery: recovered by retry-highres/paddle", "retry-highres/paddle: battery: y", "odo: z"] and a.notes[4].startswith("range: agree")
    j = json.loads(a.debugJson)
    assert [*j] == ["engines", "fields", "notes"] and [*j["fields"]] == ["range", "battery", "odo"] and j["engines"] == ["mlkit", "paddle"] and j["notes"] == ['range: agree "91"\n']
    assert j["fields"]["odo"] == {"value": 12676, "engine": "7seg", "variant": "crop", "stage": "anchor-region", "confidence": None} and j["fields"]["range"]["confidence"] == "HIGH"
    b = got[2]
    assert (b.odo, b.battery, b.range, len(b.rungEvents), b.provenance) == (None, None, None, 1, {})
    assert ladder.ladder_run(spark.createDataFrame([], OBS), ["k"]).count() == 0 and len(ladder.rungs()) == 13


def test_segment_rungs(spark):
    """Digits drawn into a photo mend a misread line and fill the region below a label."""
    img = np.full((460, 520), 20)
    digits = render("84")
    img[60:60 + digits.shape[0], 40:40 + digits.shape[1]] = digits
    at = (40, 60, 40 + digits.shape[1], 60 + digits.shape[0])
    low = render("91")
    img[300:300 + low.shape[0], 250:250 + low.shape[1]] = low
    label = (281, 242, 386, 300)
    rows = [(1, [("8A4 %", *at, None), ("x", 0, 0, 20, 20, None)], img.ravel().tolist(), 520, 460, None, None, None), (2, [("none", *at, None)], img.ravel().tolist(), 520, 460, None, None, None),
            (3, [("RANGE", *label, None)], img.ravel().tolist(), 520, 460, 5, None, None), (4, [], None, 520, 460, None, None, None), (5, None, None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, f"k int, lines {LINES}, lum array<int>, w int, h int, odo int, battery int, range int")
    fixed = {r.k: [x.text for x in r.lines] for r in ladder.repair_lines(d, ["k"]).collect()}
    assert fixed == {1: ["84", "x"]}
    got = [(r.k, r.odo, r.battery, r.range, r.notes) for r in ladder.read_regions(d, ["k"]).collect()]
    assert got == [(3, None, None, 91, ['range: segment-decoded region below anchor "RANGE" → "91"'])]
    a = anchor_for(d.where("k = 3"), "lines", "range").first().anchor
    assert a.text == "RANGE" and anchor_for(d, "lines", "speed").where("anchor is not null").count() == 0
