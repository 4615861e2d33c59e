import hashlib

from pyspark.sql import functions as F

from dashgrid import schemas
from dashgrid.operators import readings as R
from dashgrid.operators import report, stats, truth
from dashgrid.plans import evaluation
from dashgrid.sources import files
from dashgrid.streaming import live

BATCH = """rowId bigint, imageName string, mode string, odo int, battery int, range int, imageHash string, totalMillis bigint, pass1Millis bigint, ladderMillis bigint,
 rungEvents array<struct<rung:string,engine:string,variant:string,produced:array<string>,accepted:array<string>>>,
 ensembleOutcomes map<string,struct<value:int,confidence:string,engine:string,note:string,tiebreak:string>>"""
READ = "id bigint, timestamp bigint, odoKm int, batteryPct int, rangeKm int, userEdited boolean, imagePath string, imageHash string"


def rows(spark):
    ev = [("retry-highres", "paddle", "ORIGINAL", ["odo", "range"], ["odo"]), ("crop", "mlkit", "CLAHE_STRETCH", ["range"], [])]
    out = {"odo": (7, "HIGH", "both", None, None), "battery": (8, "LOW", "paddle", None, "sanity check"), "range": (None, None, None, None, None)}
    return spark.createDataFrame([
        (1, "/x/IMG_1.JPG", "ML_KIT", 12676, 84, None, "h1", 300, 100, 200, ev, None), (2, "/x/IMG_1.JPG", "BOTH", 12676, None, 91, "h1", 101, 20, 41, [], out),
        (3, "img_2.jpg", "ML_KIT", 5, None, None, "zz", None, 20, 40, None, out), (4, None, "BOTH", None, None, None, None, 100, 60, 41, [], {})], BATCH)


def truths(spark):
    return spark.createDataFrame([(1, 10, 12676, 80, None, True, "/p/a.jpg", "h1"), (2, 5, 1, 1, 1, False, "/p/b.jpg", "h1"), (3, 7, 6, 6, 6, False, "/p/IMG_2.jpg ", "h2"), (4, 9, 1, 1, 1, None, None, None)], READ)


def test_matching_and_accuracy(spark):
    r = truths(spark)
    m = truth.match_truth(rows(spark), truth.truth_by_hash(r), truth.truth_by_name(r))
    got = {x.rowId: (x.truth and x.truth.odo, x.by_hash) for x in m.collect()}
    assert got == {1: (12676, True), 2: (12676, True), 3: (6, False), 4: (None, False)}
    assert truth.match_summary(m).first().asDict() == {"images": 2, "matched": 2, "by_hash": 1, "by_name": 1, "corrected": 1, "confirmed": 1}
    acc = {(x.mode, x.field): (x.compared, x.correct) for x in stats.accuracy(m).collect()}
    assert acc["ML_KIT", "odo"] == (2, 1) and acc["BOTH", "battery"] == (1, 0) and acc["BOTH", "range"] == (0, 0)
    text = report.render(rows(spark), m, "saved readings").split("\n")
    assert text[:3] == ["IMAGES: 2    RUNS: 4", "Ground truth: 2 of 2 images matched (source: saved readings) — 1 corrected, 1 confirmed-as-is", "  matched by content hash: 1, by filename: 1"]
    assert "(a) FIELD FILL RATE PER MODE" in text and "ML_KIT     2/2 (100%)       1/2 (50%)        0/2 (0%)        " in text and "crop                            1          1          0  DEAD — never accepted" in text
    assert "anchor-region                   0          0          0  never ran" in text and "ORIGINAL                       1" in text and "odo               1        0        0" in text
    assert "    sanity check                  1" in text and "ACCURACY VS GROUND TRUTH (1 corrected, 1 as-is)" in text and "ML_KIT            150         60        120" in text
    none = truth.match_truth(rows(spark), truth.truth_by_hash(r.where("id > 9")), truth.truth_by_name(r.where("id > 9")))
    assert stats.accuracy(none).count() == 0
    text = report.render(rows(spark).where("rowId = 4"), none.where("rowId = 4"), "csv")
    assert "  !! NO IMAGES MATCHED — accuracy cannot be computed." in text and "Ground truth: 0 of 0 images matched (source: csv)" in text and "ACCURACY" not in text and "  (none)" in text and "  (BOTH mode produced no merged fields)" in text
    assert "Ground truth: none supplied" in report.render(rows(spark), none, None)


def test_rows_without_keys_are_spread(spark):
    """Two thirds of the rows have neither hash nor name; no task gets them all, whatever the adaptive execution does."""
    n = 30_000
    b = spark.range(n).selectExpr("id rowId", "if(id % 3 = 0, concat('h', id), null) imageHash", "if(id % 3 = 0, concat('n', id), if(id % 3 = 1, ' ', null)) imageName", "map('odo', 1) m")
    r = spark.range(n).selectExpr("id", "id timestamp", "1 odoKm", "1 batteryPct", "1 rangeKm", "true userEdited", "'/p/x.jpg' imagePath", "if(id % 2 = 0, concat('h', id), null) imageHash")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        m = truth.match_truth(b, truth.truth_by_hash(r), truth.truth_by_name(r))
        sizes = [x["count"] for x in m.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) < 2 * n / len(sizes) and m.where("truth is not null").count() == n // 6
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_truth_set_of_readings(spark):
    r = truths(spark)
    assert truth.truth_counts(truth.truth_by_hash(r), truth.truth_by_name(r)).first().asDict() == {
        "by_hash": 2, "by_name": 3, "corrected": 1, "confirmed": 1, "label": "saved readings — 1 corrected, 1 confirmed-as-is"}
    named = {x.hash: x.entry.filename for x in truth.truth_by_hash(r.withColumn("imagePath", F.lit(None).cast("string"))).collect()}
    assert named == {"h1": "reading_1", "h2": "reading_3"}
    assert truth.csv_label(truth.truth_by_name(r)).first().label == "ground_truth.csv (3 entries)"


def test_csv_files(spark, tmp_path):
    b = rows(spark).withColumn("provenance", F.expr("map('odo', named_struct('field', 'odo', 'value', 1, 'engine', 'both', 'variant', 'ORIGINAL', 'stage', 'pass1-ensemble', 'confidence', 'HIGH'))"))
    b = b.withColumn("groundTruth", F.when(F.col("rowId") == 2, F.expr("named_struct('filename', 'a', 'odo', 12676, 'battery', 84, 'range', cast(null as int), 'corrected', true)")))
    read = lambda p: [x for f in sorted(p.glob("part-*")) for x in f.read_text().splitlines()]
    assert report.write_batch_csv(b, str(tmp_path / "b"))
    got = read(tmp_path / "b")
    assert len(got) == 5 and got[0].startswith("image,image_hash,mode,odo,odo_engine") and got[0].count(",") == 30 and got[0].endswith("gt_range,range_correct")
    assert any(",12676,both,ORIGINAL,pass1-ensemble,HIGH,," in x and x.endswith(",1,1,12676,1,84,0,,") for x in got) and any(",retry-highres;crop,retry-highres:odo,0," in x for x in got)
    assert not report.write_batch_csv(b, str(tmp_path / "b"))   # there already
    e = spark.createDataFrame([("a,b.jpg", 1, None, 3), (None, None, None, None)], "filename string, odo int, battery int, range int")
    assert report.write_truth_csv(e, str(tmp_path / "t"))
    assert sorted(read(tmp_path / "t")) == sorted(["filename,odo,battery,range", '"a,b.jpg",1,,3', ",,,"])
    back = truth.parse_truth_csv(spark.createDataFrame([*enumerate(read(tmp_path / "t"))], "line_no int, value string"))
    assert [(x.name, x.entry.odo, x.entry.range) for x in back.collect()] == [("a,b.jpg", 1, 3)]


def test_appended_ids(spark):
    rows_ = [(1, 5), (2, None), (3, 5), (4, 86_400_000), (5, -7), (6, None), (7, 86_400_000 * 40 + 3), (8, 60_001), (9, 59_999)]
    r = spark.createDataFrame(rows_, "id bigint, timestamp bigint")
    got = {x.of: x.id for x in R.append(r, r.withColumn("of", F.col("id")), "of").collect()}
    want = sorted((i for i, _ in rows_), key=lambda i: (rows_[i - 1][1] is not None, rows_[i - 1][1] or 0, i))
    assert got == {i: 10 + k for k, i in enumerate(want)}
    assert R.append(r, r.where("id > 99")).count() == 0 and [x.id for x in R.append(r.where("id > 99"), r.where("id = 4")).collect()] == [1]


def test_views_and_settings(spark):
    one = spark.sql("SELECT 1L id, 0L timestamp, 7 odoKm, 470 batteryPct, cast(null as int) rangeKm, 'MANUAL' eventType, true userEdited, 7 ocrOdo, cast(null as int) ocrBattery, 9 ocrRange")
    g = one.select(R.save_gate(F.lit(9)).alias("g"), R.detail_text().alias("t")).first()
    assert (g.g.battery, g.g.refused, g.g.warnings) == (None, True, ["battery", "odo_lower"])
    assert g.t == "Jan 1, 1970 12:00 AM\nMANUAL\nOdometer: 7 km\nBattery: 470%\nRange: – km\nRaw OCR values — odo: 7, battery: –, range: 9\nedited"
    lines = "array(named_struct('text', 'ODO', 'left', 1, 'top', 2, 'right', 3, 'bottom', 4, 'confidence', 0.5f), named_struct('text', '7', 'left', 1, 'top', 2, 'right', 3, 'bottom', 4, 'confidence', cast(null as float)))"
    d = spark.sql(f"SELECT {lines} l, map('odo', '7 ← a') s, array('odo: x') n, cast(null as map<string,string>) s0, slice({lines}, 1, 0) l0")
    t = d.select(R.debug_text(F.col("l"), F.col("s"), F.col("n")).alias("a"), R.debug_text(F.col("l0"), F.col("s0"), F.array().cast("array<string>")).alias("b"), R.engine_text(F.lit("mlkit"), F.col("l")).alias("c"), R.engine_text(F.lit("x"), F.col("l0")).alias("d")).first()
    assert t.a == '"ODO"  [L:1 T:2 R:3 B:4]\n"7"  [L:1 T:2 R:3 B:4]\n\nField sources:\n• odo: 7 ← a\n\nParser notes:\n• odo: x' and t.b == "(no OCR lines)"
    assert t.c == 'mlkit (2 lines)\n"ODO" 0.50\n  [L:1 T:2 R:3 B:4]\n"7"\n  [L:1 T:2 R:3 B:4]' and t.d == "x (0 lines)\n(no lines)"
    m = spark.sql("SELECT explode(array('PADDLE', 'x', null)) m").select(schemas.mode_or_default(F.col("m")).alias("m")).select("m", schemas.engines_of(F.col("m")).alias("e")).collect()
    assert [(x.m, x.e) for x in m] == [("PADDLE", ["paddle"]), ("BOTH", ["mlkit", "paddle"]), ("BOTH", ["mlkit", "paddle"])]
    c = spark.sql("SELECT array('a', 'b') x, array('a', 'b', 'c') y, array('a', null) z").select(schemas.any_changed(F.col("x"), F.col("y")), schemas.any_changed(F.col("x"), F.col("z"))).first()
    assert tuple(c) == (False, True)


def test_statistics(spark):
    b = rows(spark)
    assert {(r.mode, r.field): (r.filled, r.total) for r in stats.fill_rate(b).collect()}["ML_KIT", "battery"] == (1, 2)
    rung = {r.rung: (r.ran, r.produced, r.accepted, r.is_dead) for r in stats.rung_table(b).collect()}
    assert rung["retry-highres"] == (1, 2, 1, False) and rung["crop"] == (1, 1, 0, True) and rung["anchor-region"] == (0, 0, 0, False) and len(rung) == 8
    assert [tuple(r) for r in stats.engine_variant(b).collect()] == [("paddle", "ORIGINAL", 1)]
    assert {(r.field, r.confidence): r.n for r in stats.merge_outcomes(b).collect()} == {("odo", "HIGH"): 1, ("battery", "LOW"): 1}
    assert {r.tiebreak: r.n for r in stats.tiebreak_counts(b).collect()}["sanity check"] == 1
    lat = {r.mode: (r.runs, r.avg_total, r.avg_pass1, r.avg_ladder) for r in stats.latency(b).collect()}
    assert lat == {"ML_KIT": (2, 150, 60, 120), "BOTH": (2, 100, 40, 41)}
    empty = b.where("rowId > 9")
    assert stats.fill_rate(empty).count() == 0 and stats.rung_table(empty).count() == 8


def test_truth_csv(spark):
    lines = ["filename,odo,battery,range", "# note", "", " a/IMG_001.jpg , 12676,84,91", "img_002.jpg,5,,x", "IMAGE,1,2,3", "IMG_002.JPG,7,12.5,", '"my, photo.jpg",100']
    d = spark.createDataFrame([*enumerate(lines)], "line_no int, value string")
    got = {r.name: (r.entry.odo, r.entry.battery, r.entry.range) for r in truth.parse_truth_csv(d).collect()}
    assert got == {"img_001.jpg": (12676, 84, 91), "img_002.jpg": (7, None, None), "my, photo.jpg": (100, None, None)}


def test_readings_table(spark):
    r = truths(spark)
    assert [x.id for x in R.newest_first(r).collect()] == [1, 4, 3, 2] and R.max_odo(r.where("id > 9")).first()[0] is None
    more = R.append(r, r)
    assert sorted((x.id, x.timestamp) for x in more.collect()) == [(5, 5), (6, 7), (7, 9), (8, 10)]
    files_ = spark.createDataFrame([("/p/z.jpg", b"abc")], "path string, content binary")
    lacking = r.withColumn("imageHash", F.lit(None).cast("string")).withColumn("imagePath", F.when(F.col("id") == 3, "/p/z.jpg").otherwise(F.col("imagePath")))
    upd = R.backfill_hashes(lacking, files_)
    assert [tuple(x) for x in upd.collect()] == [(3, hashlib.sha256(b"abc").hexdigest())]
    whole, n = R.backfill(lacking, files_)
    assert whole.where("imageHash is not null").count() == 1 and n.first().updated == 1
    diff = R.snapshot_diff(r, r.where("id <> 1").withColumn("odoKm", F.when(F.col("id") == 2, 9).otherwise(F.col("odoKm"))), "id", ["odoKm", "rangeKm"])
    assert {x.id: x.change for x in diff.collect()} == {1: "removed", 2: "changed"}
    assert R.migrate(r, {"debugJson": "string", "id": "int"}).columns == [*r.columns, "debugJson"]


def test_snapshot_of_the_largest_odometer(spark, tmp_path):
    """The largest int has no next one: an edited reading that holds it, or a null, fails nothing."""
    top = 2**31 - 1
    values = [(1, top, True), (2, top, False), (3, None, True), (4, -top - 1, True), (5, 8, True), (6, top, None), (7, top, True), (8, top - 1, True), (11, top, True), (77, top, True)]
    r = spark.createDataFrame([(i, i, o, None, 1, e, None, None) for i, o, e in values], READ)
    r.write.parquet(str(tmp_path / "readings.parquet"))
    got = {x.id: x.change for x in evaluation.snapshot_diff(spark, str(tmp_path)).collect()}
    assert got == {1: "changed", 4: "changed", 5: "changed", 7: "removed", 8: "changed", 11: "added"}


def test_files(spark, tmp_path):
    for n, b in {"a.JPG": b"1", "b.png": b"2", "c.txt": b"3", "d": b"\x89PNG\r\n\x1a\nxxxxx", "ground_truth.csv": b"4", "Ground_Truth.CSV": b"5"}.items():
        (tmp_path / n).write_bytes(b)
    (tmp_path / "sub").mkdir()
    truth_, images = files.split_inputs(files.list_folder(spark, str(tmp_path)))
    assert [r.name for r in truth_.collect()] == ["Ground_Truth.CSV"] and sorted(r.name for r in images.collect()) == ["a.JPG", "b.png", "d", "ground_truth.csv"]
    assert files.list_folder(spark, str(tmp_path), content=False).count() == 4

    def bad(_):
        raise ValueError

    got = files.recognise(images, {"ok": lambda b: [(b.decode(), 0, 0, 1, 1, 0.5)], "bad": bad}, ["name"]).collect()
    assert {(r.name, r.engine): len(r.lines) for r in got if r.name == "b.png"} == {("b.png", "ok"): 1, ("b.png", "bad"): 0}
    tiff = b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + (len(tiff) + 8).to_bytes(2, "big") + b"Exif\0\0" + tiff + b"\xff\xda"
    assert files.exif_orientation(jpeg) == 6 and files.exif_orientation(b"") == 1 and files.exif_orientation(None) == 1
    assert files.scaled_size(4000, 3000, 1920) == (1920, 1440) and files.read_dictionary("a\nb\n") == ["a", "b"]


def test_live_results(spark, tmp_path):
    r, seen = truths(spark), []
    folder = str(tmp_path / "in")
    r.where("id < 3").write.parquet(folder)
    q = lambda: live.live_newest(spark, folder, r.schema, lambda df, _: seen.append([x.id for x in df.collect()]), str(tmp_path / "cp")).awaitTermination()
    q()
    r.where("id >= 3").write.mode("append").parquet(folder)
    q()
    assert seen == [[1, 2], [1, 4, 3, 2]]
    s = live.watch(spark, folder, r.schema).withColumn("vehicleId", F.lit(1))
    c = live.live_counts(s).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    c.awaitTermination()
    assert spark.table("counts").first().n == 4
