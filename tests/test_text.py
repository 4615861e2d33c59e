from pyspark.sql import functions as F

from dashgrid.functions import spatial as S
from dashgrid.functions import text as T


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def test_normalising(spark):
    assert one(spark, "\t Odo 12 \n", T.normalise_line) == "ODO 12"
    assert one(spark, "/a/b/ IMG_1.JPG ", T.normalise_name) == "img_1.jpg"
    assert one(spark, None, T.normalise_name) is None
    assert one(spark, "A-1 B2", T.tokens) == ["A", "1", "B2"]
    assert one(spark, "", T.tokens) == []


def test_digit_repair_needs_a_digit(spark):
    assert one(spark, "L2941 KM", T.repair_digits) == "12941 KM"
    assert one(spark, "SO OLD", T.repair_digits) == "SO OLD"


def test_fuzzy_labels(spark):
    hit = lambda t, *labels: one(spark, t, lambda c: T.line_matches(c, labels))
    assert hit("8ATTERY", "BATTERY") and hit("RAN6E", "RANGE") and hit("X ODO Y", "ODO")
    assert hit("0D0", "ODO") and not hit("00", "ODO") and not hit("SPEED", "RANGE")


def test_values(spark):
    assert one(spark, "BATT 84 %", T.battery_value) == 84
    assert one(spark, "470 %", T.battery_value) is None
    assert one(spark, "OIL", T.battery_value) is None
    assert one(spark, "91KM", T.range_value) == 91
    assert one(spark, "7 612 KM", T.odo_value) == 7612
    assert one(spark, "ODO 12,676.5 KM", T.odo_value) == 12676
    assert one(spark, "123.4", T.odo_value) == 123
    assert one(spark, "12.5", T.strict_int) is None and one(spark, " +7 ", T.strict_int) == 7 and one(spark, "99999999999", T.strict_int) is None


def test_separators(spark):
    for given, want in {"12.676": "12676", "0.0": "0.0", "1.2.3": "12.3", "1.234.567": "1234567", "42": "42"}.items():
        assert one(spark, given, T.normalise_separators) == want


def test_csv(spark):
    for line, cells in {'"my, photo.jpg",100,': ["my, photo.jpg", "100", ""], 'x"y,z"w,1': ["xy,zw", "1"], '"a""b",c': ['a"b', "c"], '"open,end': ["open,end"], "": [""]}.items():
        assert one(spark, line, T.csv_split) == cells
    assert one(spark, 'a"b', T.csv_escape) == '"a""b"' and one(spark, "plain", T.csv_escape) == "plain"
    r = spark.sql("SELECT 1L h, 8L t UNION ALL SELECT 0L, 0L").select(T.ratio_text(F.col("h"), F.col("t")).alias("x")).collect()
    assert sorted(x.x for x in r) == ["1/8 (13%)", "—"]


def test_spatial(spark):
    box = lambda l, t, r, b: f"named_struct('left',{l},'top',{t},'right',{r},'bottom',{b})"  # noqa: E731, E741
    q = lambda a, b: spark.sql(f"SELECT {box(*a)} a, {box(*b)} b").select(S.below_or_beside(F.col("a"), F.col("b")).alias("near"), S.relation(F.col("a"), F.col("b")).alias("how")).first()
    assert tuple(q((0, 0, 50, 20), (5, 25, 45, 45))) == (True, "nearest-below")
    assert tuple(q((0, 0, 50, 20), (60, 0, 90, 20))) == (True, "nearest-beside")
    assert not q((0, 0, 50, 20), (400, 0, 450, 20)).near and not q((0, 0, 50, 20), (0, 25, 300, 225)).near
    pts = "array(" + ",".join(f"named_struct('x',{x}D,'y',{y}D)" for x, y in ((0, 0), (90, 0), (90, 40), (0, 40))) + ")"
    m = spark.sql(f"SELECT {pts} p").select(S.quad_metrics(F.col("p")).alias("q")).first().q
    assert m.area == 3600 and m.width == 90 and m.skew < 0.5 and not m.degenerate
