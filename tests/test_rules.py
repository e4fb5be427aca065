"""Truth tables and golden cases for the column rules."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from landlens.functions import address as A
from landlens.functions import dates as D
from landlens.functions import description as X
from landlens.functions import html as H
from landlens.functions import numeric as N
from landlens.functions import rules as R
from landlens.functions import text as T


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
    return [r.o for r in df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


def test_number_from_text(spark):
    texts = ["45,65 tỷ", "~194,44 triệu/m²", "1.234,56", "1,234.56", "194,44", "+23%", "-5%", "abc", ".", "", None]
    want = [45.65, 194.44, 1234.56, 1234.56, 194.44, 23.0, -5.0, None, None, None, None]
    assert column(spark, texts, T.clean_numeric) == want


def test_money(spark):
    texts = ["45,65 tỷ", "500 triệu", "12 tr./m²", "5"]
    assert column(spark, texts, T.parse_money_total) == [45.65, 0.5, 0.012, 5.0]
    assert column(spark, texts, T.parse_money_per_m2) == [45650.0, 500.0, 12.0, 5.0]


def test_canonical_keeps_stroke_letter_unless_folded(spark):
    assert column(spark, ["  Đường   SỐ 5 m² … ﬁ "], T.canonical) == ["đuong so 5 m2 ... fi"]
    assert column(spark, ["Đường"], lambda c: T.canonical(c, fold_d=True)) == ["duong"]
    decomposed = "Hình ảnh"
    assert column(spark, [decomposed], T.canonical) == ["hinh anh"]


@pytest.mark.parametrize(
    ("fn", "values", "want"),
    [
        (R.road_class, [3.0, 3.5, 5.0, 10.0, 10.5], ["Ngõ nhỏ (<3m)", "Ngõ xe ba gác (3-5m)", "Ngõ xe ba gác (3-5m)", "Đường xe hơi (5-10m)", "Đường lớn (>10m)"]),
        (R.frontage_class, [4.9, 5.0, 5.1, 10.0, 10.5], ["Nhỏ (<5m)", "Tiêu chuẩn (5m)", "Khá (5-10m)", "Khá (5-10m)", "Rất rộng (>10m)"]),
        (R.trend_class, [-0.1, 0.0, 5.0, 20.0, 50.0, 50.1], ["Giảm giá", "Ổn định (0-5%)", "Ổn định (0-5%)", "Tăng trưởng (5-20%)", "Tăng trưởng nóng (20-50%)", "Tăng trưởng đột biến (>50%)"]),
        (N.segmented_road, [2.25, 15.0, 15.5, 16.5, 30.0, 31.0, None], [2.0, 15.0, 16.0, 16.0, 30.0, 30.0, None]),
        (N.segmented_frontage, [5.04, 9.96, 10.25, 20.0, 20.1], [5.0, 10.0, 10.0, 20.0, 20.0]),
        (N.capped_trend, [150.04, 150.06, -50.06, 3.25], [150.0, 150.0, -50.0, 3.2]),
        (N.half_step, [0.25, 0.75, 1.2], [0.0, 1.0, 1.0]),
    ],
)
def test_numeric_rules(spark, fn, values, want):
    assert column(spark, values, fn, "double") == want


def test_bins_and_missing_values(spark):
    assert column(spark, [-51.0, -49.0, 49.0, 51.0, None], lambda c: N.bin_toward_zero(c, 50.0), "double") == [-50.0, 0.0, 0.0, 50.0, None]
    assert column(spark, [-0.1, 0.6], lambda c: N.bin_floor(c, 0.5), "double") == [-0.5, 0.5]


def test_unit_price_guards(spark):
    df = spark.createDataFrame([(100, 0.0), (100, None), (None, 5.0), (1000, 3.0), (100, 8.0)], "p long, a double")
    got = [r.u if r.u is None else float(r.u) for r in df.select(N.guarded_unit_price(F.col("p"), F.col("a")).alias("u")).collect()]
    assert got == [0.0, 0.0, None, 333.0, 12.5]


def test_look_alike_flags_differ_at_the_edge(spark):
    df = spark.createDataFrame([(40.0, 3), (39.0, 3), (None, 3), (39.0, None)], "a double, b int")
    rows = df.select(R.overcrowded(F.col("a"), F.col("b")).alias("flag"), R.crowding(F.col("a"), F.col("b")).alias("rate")).collect()
    assert [(r.flag, r.rate) for r in rows] == [(False, True), (True, True), (False, True), (False, False)]


def test_plot_shape_with_zero_frontage(spark):
    df = spark.createDataFrame([(60.0, 0.0), (None, 5.0), (37.5, 5.0), (75.0, 5.0), (125.0, 5.0)], "a double, f double")
    label, order = R.plot_shape(F.col("a"), F.col("f"))
    assert [(r.l, r.o) for r in df.select(label.alias("l"), order.alias("o")).collect()] == [
        ("Mặt tiền rộng", 1), ("Thiếu thông tin", 99), ("Cân đối", 2), ("Nhà hẹp dài", 3), ("Ống siêu dài", 4),
    ]


def test_segment_label_and_order_may_disagree(spark):
    df = spark.createDataFrame([(10.4,), (None,)], "p double")
    label, order = R.price_segment(F.col("p"), F.lit(10.6), F.lit(20.0))
    assert [tuple(r) for r in df.select(label, order).collect()] == [("Bình dân", 1), ("Không xác định", 4)]
    label, order = R.price_segment(F.col("p"), F.lit(10.3), F.lit(20.0))
    assert tuple(df.select(label, order).first()) == ("Trung bình", 2)
    label, order = R.price_segment(F.lit(10.8), F.lit(10.6), F.lit(20.0))
    assert tuple(df.select(label, order).first()) == ("Bình dân", 2)


def test_interior_and_title_rules(spark):
    interiors = [None, "  ", "Sổ photo đẹp", "Nhà trống", "Giao thô", "Nội thất tinh tế", "Cơ bản", "Để lại full", "Tặng hoa", "Luxury. Thô?"]
    want = ["Không rõ", "Không rõ", "Không rõ", "Không nội thất", "Thô", "Cao cấp", "Cơ bản", "Đầy đủ", "Không rõ", "Thô"]
    assert column(spark, interiors, R.interior_label) == want
    titles = [None, "Sổ chung", "HĐMB", "Đang chờ sổ", "chờ cấp", "vi bằng"]
    assert column(spark, titles, R.title_label) == [None, "Sổ chung", "Hợp đồng mua bán", "Sổ hồng/Sổ đỏ", "Đang chờ sổ", "Chưa xác định"]


def test_text_to_bool(spark):
    assert column(spark, [" True ", "FALSE", "", "x", None], R.text_to_bool) == [True, False, None, None, None]


def test_address(spark):
    got = column(spark, ["Đường D4, Phường Phú Mỹ, Quận 7, Hồ Chí Minh", "Hẻm 3, TP. HCM", "", "TP. Huế"], A.parse_address)
    assert [(r.city, r.district, r.ward, r.street) for r in got] == [
        ("Hồ Chí Minh", "Quận 7", "Phường Phú Mỹ", "Đường D4"), ("HCM", "Hẻm 3", None, "Hẻm 3"), ("", "", None, None), ("Huế", "", None, None),
    ]


def test_dates(spark):
    assert column(spark, ["x 28/04/2026 y", "31/02/2026", None], D.parse_date) == [dt.date(2026, 4, 28), None, None]


DEMO = (
    "Nhà đẹp Tải ứng dụng 0 1 Tin đăng đã lưu Đăng ký Thông tin mô tả C17/10 Đường Liên Ấp 2 - 3 - 4, Bình Chánh. Thông tin chi tiết: "
    "- Diện tích: 223.9m². - Kết cấu: - Nhà trước: cấp 4. Lợi thế vượt trội: - Mặt tiền. Ngày đăng 28/04/2026"
)


def test_description_demo(spark):
    got = column(spark, [DEMO, "", None], lambda c: X.clean_description(c, F.lit("Nhà  đẹp"), "nha.example.com"))
    assert got[0].split("\n") == [
        "C17/10 Đường Liên Ấp 2 - 3 - 4, Bình Chánh.", "Thông tin chi tiết:", "- Diện tích: 223.9m².", "- Kết cấu:", "- Nhà trước: cấp 4.",
        "Lợi thế vượt trội:", "- Mặt tiền.",
    ]
    assert got[1:] == ["Nhà đẹp", "Nhà đẹp"]


def test_decomposed_markers(spark):
    apart = unicodedata.normalize("NFD", "Mô tả: nhà rộng Hình ảnh 5")
    tones = "Mô tả: nhà rộng Hình ảnh 5".replace("ả", "ả").replace("ì", "ì")
    assert column(spark, [apart, tones], lambda c: X.trim_between_markers(c, "s", "")) == ["nhà rộng", "nhà rộng"]
    noise = unicodedata.normalize("NFD", "Đăng ký nhà Tin đăng đã lưu 5")
    assert column(spark, [noise], X.remove_noise) == ["nhà 5"]


def test_marks_join_their_letters_in_any_order(spark):
    letters = "ệ ở ữ ǭ é ñ ậ ế Ǻ"
    forms = [unicodedata.normalize("NFD", letters), letters, "e\u0302\u0323 ê\u0323 ẹ\u0302", "x\u0301\u0323 中 a", None, "e\u0301 e\u0301\u0323"]
    got = column(spark, forms, T.compose)
    assert got[:2] == [letters, letters] and got[2] == "ệ ệ ệ" and got[3].startswith("x") and got[4] is None
    assert got[5].split() [0] == "é"
    text = unicodedata.normalize("NFD", "Mặt tiền 5 m, Đường vào 4 m")
    df = spark.createDataFrame([(text,)], "s string")
    f = T.numeric_features(F.col("s"), F.array("s"))
    assert tuple(df.select(f["frontage"], f["road_width"]).first()) == (5.0, 4.0)


def test_long_spellings_cost_no_more_than_twice(spark):
    import time

    plain = spark.range(3000).select(F.repeat(F.concat(F.lit("Đường số "), F.col("id").cast("string"), F.lit(" ")), 60).alias("s"))
    times = []
    for df in (plain, plain, plain.select(F.concat("s", F.lit("… ﬁ")).alias("s"))):
        start = time.perf_counter()
        df.select(T.strip_accents(F.col("s"))).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    assert times[2] < 2 * times[1] + 1.0
    assert column(spark, ["½ … ﬁ đé Ⅷ"], T.strip_accents) == ["1⁄2 ... fi đe VIII"]


def test_dot_segments_of_references(spark):
    from urllib.parse import urljoin

    from landlens.operators.pages import resolved_path

    base = "http://a/b/c/d;p?q"
    references = ["g", "./g", "g/", "/g", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g?y/./x", "g#s/../x"]
    paths = [r if r.startswith("/") else "/b/c/" + r for r in references]
    assert ["http://a" + x for x in column(spark, paths, resolved_path)] == [urljoin(base, r) for r in references]


def test_nested_items_end_at_their_own_tag(spark):
    page = (
        "<div class='a re__x b' title=\"K&amp;L\"><div><b>một</b></div>hai</div><p>ngoài</p><div class=\"re__x\">ba<br></div>"
        "<div class='re__x-title'>không</div><div class='re__x'>hở"
    )
    df = spark.createDataFrame([(page,)], "s string").select(H.tags(H.drop_silent(F.col("s"))).alias("tags"))
    got = df.select(F.expr(f"transform({H.elements('tags', 're__x')}, e -> {H.tag_text('e.inner')})").alias("o")).first().o
    assert got == ["mộthai", "ba", "hở"]
    heads = df.select(F.expr(f"transform({H.elements('tags', 're__x')}, e -> {H.attribute('e.head', 'title')})").alias("o")).first().o
    assert heads == ["K&L", None, None]
    assert column(spark, ["&lt;b&gt; &#7879; &#x1EC7; &copy; &bad; &amp;amp; & x"], lambda c: H.page_text(c)) == ["<b> ệ ệ © &bad; &amp; & x"]


def test_cells_that_are_no_finite_number_are_missing(spark):
    from landlens.functions.numeric import to_double, to_long
    from landlens.operators.quantiles import exact_percentiles

    cells = spark.createDataFrame([(t,) for t in ("10", "20", "30", "nan", "inf", "-Infinity", "x", None)], "cell string")
    got = cells.select(to_double(F.col("cell")).alias("d"), to_long(F.col("cell")).alias("l")).collect()
    assert [tuple(r) for r in got] == [(10.0, 10), (20.0, 20), (30.0, 30)] + [(None, None)] * 5
    raw = cells.select(F.col("cell").try_cast("double").alias("v"))
    assert tuple(exact_percentiles(raw, "v", [0.25, 0.75], ["q1", "q3"]).select("q1", "q3", "n").first()) == (15.0, 25.0, 3)


def test_questions_are_queries_only(spark, tmp_path):
    from landlens.operators.adhoc import ask

    df = spark.range(3).toDF("n")
    assert ask(df, "SELECT 'a;b' AS x, n FROM listings;").count() == 3
    for sql in (f"WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{tmp_path}/out' USING parquet SELECT * FROM a", "CREATE TABLE t AS SELECT 1", "SELECT 1; SELECT 2", ""):
        with pytest.raises(ValueError):
            ask(df, sql)
    assert not (tmp_path / "out").exists()


def test_streams_read_tables_that_are_folders(spark, sf_dir, tmp_path):
    from landlens.catalog.incremental import x1

    spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    assert x1(spark, str(tmp_path)).count() == 50


def test_markers_are_looked_for_only_where_one_may_start(spark):
    letters = sorted({w[0] for w in X.START_MARKERS + X.STOP_MARKERS} | set("kisßđ"))
    guarded = X._any(letters)
    assert "(?=[" in guarded
    chars = spark.createDataFrame([(c,) for c in map(chr, range(1, 0x10000)) if not 0xD800 <= ord(c) <= 0xDFFF], "c string")
    wrong = chars.where(F.col("c").rlike(guarded) != F.col("c").rlike("(?iu)" + X._grouped(letters)))
    assert [r.c for r in wrong.collect()] == []


def test_pages_are_read_with_one_pattern_a_class_list_and_no_copied_tags(spark):
    page = "<div class='re__x\n a'>1<span class=\"t\">&#226;&#;&#x;&bogus;</span><div>2</div></div>3<DIV CLASS=re__x>4<span class=t>5 <a>1<2</DIV><p class='re__x'>" + "<b>x</b>" * 40
    df = spark.createDataFrame([(page,), ("",), (None,)], "html string").select(H.tags(H.drop_silent(F.col("html"))).alias("tags"))
    # the pattern stood in the plan for each use of its match
    assert df._jdf.queryExecution().analyzed().toString().count("sclass") == 1
    inside, text = H.first_text("e.inner", "t"), H.tag_text("e.inner")
    copied = f"transform({H.elements('tags', 're__x')}, e -> concat_ws('|', {inside}, {text}, e.head))"
    cut = H.each_element("tags", "re__x", lambda head, inner, whole: f"concat_ws('|', {H.first_text(inner, 't')}, {H.tag_text(whole)}, {head})")
    rows = df.select(F.expr(copied).alias("a"), F.expr(cut).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert rows[0].b[0].startswith("â&#;&#x;&bogus;|1â&#;&#x;&bogus;2|") and len(rows[0].b) == 3 and rows[1].b == [] and rows[2].b is None
