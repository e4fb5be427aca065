"""Invariants of the star, exact percentiles under skew, plan shape, streams."""

import random
import re
import statistics

from pyspark.sql import functions as F

import __spark_entry__ as entry
from landlens.catalog import frames
from landlens.operators import pages as P
from landlens.operators import star as S
from landlens.operators.profile import top_values
from landlens.operators.quantiles import exact_percentiles, magnitude_range
from landlens.operators.relational import first_per_key, update_by_key, with_sequence_key
from landlens.session import shared_dir
from landlens.sources.pages import SITE, listing_pages
from landlens.streaming import ingest as I


def test_csv_with_quotes_breaks_and_empties_over_many_splits(spark, tmp_path):
    from landlens.sources import tables as S

    rng = random.Random(4)
    cells = ["", None, "a", 'say "hi"', "two\nlines", "\n", '"', ' lead', "trail ", "x,y", '"\n"', "é\r\nü", "w" * 90, "\n".join("abcdefg")]
    columns = [f"c{k}" for k in range(30)]
    rows = [tuple([str(i)] + [rng.choice(cells) for _ in range(29)]) for i in range(150)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).coalesce(2)
    S.write_csv(df, f"{tmp_path}/t")
    S.write_segments(df, f"{tmp_path}/s", F.when(F.col("c0") < "5", "a b").otherwise("c"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("300b", "7000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = S.read_csv(spark, f"{tmp_path}/t", columns)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
        by_folder = S.read_segments(spark, f"{tmp_path}/s", columns).collect()
        assert sorted((tuple(r)[:-1] for r in by_folder), key=str) == sorted(rows, key=str) and {r.segment for r in by_folder} == {"a b", "c"}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_star_keys_are_dense_and_lookups_do_not_multiply(spark, sf_dir):
    clean = frames.clean(spark, sf_dir)
    star = S.build_star(clean)
    fact = star["fact"]
    n = fact.count()
    assert n == clean.select("product_id", "posted_date").distinct().count()
    for name, key in [("location", "location_skey"), ("features", "feature_skey"), ("details", "status_skey"), ("product", "product_skey")]:
        dim = star[name]
        size, lo, hi, ids = dim.agg(F.count(F.lit(1)), F.min(key), F.max(key), F.count_distinct(key)).first()
        assert (lo, hi, ids) == (1, size, size), name
        assert fact.where(F.col(key).isNull()).count() == 0
    assert fact.agg(F.max("listing_id"), F.count_distinct("listing_id")).first()[:] == (n, n)


def test_star_and_plain_view_agree(spark, sf_dir):
    clean = frames.clean(spark, sf_dir)
    cols = ["city", "district", "interior", "legal_class", "price_total"]
    by_key = S.star_view(S.build_star(clean)).select(*cols)
    plain = S.listing_view(clean, cols).select(*cols)
    assert by_key.exceptAll(plain).count() == 0 and plain.exceptAll(by_key).count() == 0


def test_percentiles_with_one_hot_value_and_group(spark):
    random.seed(7)
    rows = [("hot", 5.0)] * 3000 + [("hot", random.uniform(-1e6, 1e6)) for _ in range(4000)] + [("b", 0.0), ("b", -3.0), ("c", None), (None, 2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_percentiles(df, "v", [0.0, 0.25, 0.5, 1.0], ["lo", "q1", "q2", "hi"], by=["g"]).collect()}
    hot = sorted(v for g, v in rows if g == "hot")
    assert got["hot"].n == 7000 and got["hot"].q2 == statistics.median(hot)
    assert abs(got["hot"].q1 - statistics.quantiles(hot, n=4, method="inclusive")[0]) < 1e-6
    assert (got["hot"].lo, got["hot"].hi) == (hot[0], hot[-1])
    assert (got["b"].q2, got[None].q2) == (-1.5, 2.5) and "c" not in got


def test_percentiles_of_concentrated_values(spark):
    from landlens.operators import quantiles as Q

    n = 1_000_000
    df = spark.range(n).select((F.lit(1000.0) + F.pmod(F.col("id") * 7919, F.lit(n)) * 1e-5).alias("v"))
    got = exact_percentiles(df, "v", [0.25, 0.5, 0.999], ["a", "b", "c"]).first()
    want = [1000.0 + p * (n - 1) * 1e-5 for p in (0.25, 0.5, 0.999)]
    assert all(abs(x - y) < 1e-6 for x, y in zip((got.a, got.b, got.c), want, strict=True)) and got.n == n
    # the values of the last parts, which are sorted, are few
    tight = spark.range(200_000).select(F.lit(0).alias("__g"), (F.lit(1.0) + F.col("id") * 1e-15 * 4).alias("__v"), F.lit(1).alias("__n"))
    counts, parents, found = tight.withColumn("__r0", magnitude_range(F.col("__v"))), [], None
    for level in range(Q.LEVELS + 1):
        if found is not None:
            counts = Q._inside(counts, found, ["__g"], parents).withColumn(f"__r{level}", Q._sub_range())
        found = Q._wanted_ranges(counts, ["__g"], parents, f"__r{level}", [0.5])
        parents.append(f"__r{level}")
    assert Q._inside(counts, found, ["__g"], parents).count() <= 2


def test_magnitude_ranges_keep_order(spark):
    values = sorted([0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300] + [random.uniform(-1e9, 1e9) for _ in range(500)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    ranges = [r.r for r in df.select("i", magnitude_range(F.col("v")).alias("r")).orderBy("i").collect()]
    assert ranges == sorted(ranges)


def test_first_row_of_a_hot_key(spark):
    df = spark.range(10000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), (-F.col("id")).alias("pos"), "id")
    first = first_per_key(df, ["k"], ["pos"])
    assert first.where("k = 1").first().id == 9999 and first.count() == df.select("k").distinct().count()


def test_sequence_key_is_stable(spark):
    df = spark.range(5000).select((F.col("id") * 7).alias("k"))
    a = with_sequence_key(df, ["k"], "n")
    b = with_sequence_key(df.repartition(13), ["k"], "n")
    assert a.exceptAll(b).count() == 0
    assert a.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (1, 5000, 5000)


def test_update_by_key_writes_nulls_too(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "url string, x int")
    upd = spark.createDataFrame([("a", None)], "url string, x int")
    assert sorted(tuple(r) for r in update_by_key(base, upd, "url", ["x"]).collect()) == [("a", None), ("b", 2)]


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "bbaaccd"], "x string")
    assert [(r.value, r.n) for r in top_values(df, ["x"], 2).orderBy("rank").collect()] == [("a", 2), ("b", 2)]


def test_plans_stay_native(spark, sf_dir):
    for name in ["q1_clean_listings", "q5_price_histogram", "q7_outlier_thresholds", "h5_area_and_frontage", "t27_clean_description", "w8_sequence_key"]:
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, (name, bad)


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderstatus") == "F").groupBy("o_orderpriority").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan


def test_stream_equals_batch_and_retries_rejects(spark, sf_dir):
    as_of = F.to_date(F.lit("2024-01-01"))
    pages = listing_pages(spark, sf_dir)
    folder, out, progress = (shared_dir(spark, n) for n in ("in", "out", "progress"))
    pages.write.parquet(folder)
    I.ingest_pages(spark, folder, out, progress, SITE, as_of).awaitTermination()
    first = I.read_listings(spark, out).count()
    valid, rejected = P.split_listings(pages, SITE, as_of)
    assert first == valid.count() and I.read_rejects(spark, out).count() == rejected.count()
    # A second delivery repairs the blocked pages: only those are new.
    repaired = pages.withColumn("html", F.replace("html", F.lit("CF-Challenge"), F.lit("ok")))
    repaired.write.mode("append").parquet(folder)
    I.ingest_pages(spark, folder, out, progress, SITE, as_of).awaitTermination()
    fixed = rejected.where("reject_reason = 'blocked page'").count()
    assert fixed > 0 and I.read_listings(spark, out).count() == first + fixed


def test_written_star_has_both_date_tables(spark, sf_dir, tmp_path):
    clean = frames.clean(spark, sf_dir)
    S.write_star(clean, str(tmp_path / "star"))
    star = S.read_star(spark, str(tmp_path / "star"))
    view = S.star_view(star)
    assert view.count() == star["fact"].count()
    for role, column in S.DATE_ROLES.items():
        days = star[f"{role}_dates"]
        lo, hi, n = days.agg(F.min("date"), F.max("date"), F.count_distinct("date")).first()
        assert (lo.month, lo.day, hi.month, hi.day) == (1, 1, 12, 31) and n == days.count() == (hi - lo).days + 1
        wrong = view.where(~F.col(f"{role}_year").eqNullSafe(F.year(column)) | ~F.col(f"{role}_day").eqNullSafe(F.dayofmonth(column)))
        assert wrong.count() == 0


def test_compressed_csv_is_cut_into_bounded_files_and_read_back(spark, tmp_path, monkeypatch):
    from landlens.sources import tables as S

    monkeypatch.setattr(S, "COMPRESSED_RECORDS", 10)
    cells = ["plain", "two\nlines", 'say "hi"', "", None, "\n"]
    rows = [(str(i), cells[i % 6] if i >= 60 else "plain", "end") for i in range(120)]
    df = spark.createDataFrame(rows, "a string, b string, c string").coalesce(1)
    S.write_csv(df, f"{tmp_path}/t", compression="gzip")
    assert len(list(tmp_path.glob("t/*.csv.gz"))) == 12
    got = S.read_csv(spark, f"{tmp_path}/t", ["a", "b", "c"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)


def test_cleaning_rules_evaluate_their_text_once(spark):
    from landlens.functions.description import clean_description
    from landlens.functions.text import numeric_features

    df = spark.createDataFrame([("a", "b")], "text string, title string")
    cleaned = df.select(clean_description(F.col("text"), F.col("title"), "x.example").alias("c"))
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    # one start and one stop pattern, however deep the rules behind them are
    assert plan.count("split(") <= 6, plan.count("split(")
    price = df.select(numeric_features(F.col("text"), F.array("text"))["bedrooms"].alias("n"))
    assert price._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 3


def test_view_moves_only_the_columns_read(spark):
    rows = [(1, "2024-01-01", "b", "x", 1.0), (1, "2024-01-01", "a", "y", 2.0), (2, None, "c", None, 3.0), (None, None, "d", "z", 4.0), (None, None, "e", "z", 5.0)]
    clean = spark.createDataFrame(rows, "product_id bigint, posted_date string, src_pos string, city string, price_total double")
    view = S.listing_view(clean, ["city", "price_total"])
    assert sorted(r.price_total for r in view.collect()) == [2.0, 3.0, 4.0]
    plan = view.select("price_total")._jdf.queryExecution().executedPlan().toString()
    moved = plan[plan.index("Exchange"):].split("LogicalRDD")[0].split("Scan")[0]
    assert "city" not in moved


def test_star_moves_product_texts_only_into_their_dimension(spark, sf_dir, monkeypatch):
    from landlens.operators import clean as C

    clean = frames.clean(spark, sf_dir)
    star = S.build_star(clean)
    for df in (star["fact"], S.star_view(star)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "exclamation_count" not in plan
    keys = star["product"].select("product_skey", "product_id")
    assert keys.exceptAll(star["product_keys"].select(*keys.columns)).count() == 0
    # columns that don't depend on the medians are kept without a pass for them
    monkeypatch.setattr(C, "exact_medians", None)
    kept = ["product_id", "posted_date", "price_total"]
    narrow = frames.clean(spark, sf_dir, kept)
    assert narrow.exceptAll(clean.select(*narrow.columns)).count() == 0 and narrow.count() == clean.count()


def test_listing_ids_are_those_of_the_fact(spark):
    rows = [(1, "2024-01-01", "b"), (1, "2024-01-01", "a"), (1, None, "c"), (1, None, "d"), (2, "2024-01-01", "e"), (None, "2024-01-02", "f"), (None, "2024-01-02", "g"), (None, None, "h")]
    clean = spark.createDataFrame(rows, "product_id bigint, posted_date string, src_pos string").withColumn("posted_date", F.col("posted_date").cast("timestamp"))
    ids = S.listing_ids(clean)
    plain = S.null_safe_lookup(S.deduplicated(clean), S.product_keys(clean), ["product_id"], ["product_skey"])
    plain = S.with_sequence_key(plain.select("product_skey", "posted_date"), ["product_skey", "posted_date"], "listing_id", digits=4)
    got = sorted(map(tuple, ids.collect()), key=str)
    assert got == sorted(map(tuple, plain.collect()), key=str) and sorted(x[2] for x in got) == [1, 2, 3, 4, 5]
    assert "src_pos" not in ids._jdf.queryExecution().executedPlan().toString()


def test_split_listings_extract_only_what_is_asked_for(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(P, "materialise", lambda df, name: seen.append(df) or df)
    P.split_listings(listing_pages(spark, sf_dir), SITE, F.to_date(F.lit("2024-01-01")), columns=["url"])
    assert seen[0].columns == ["url", "reject_reason"]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "is_verified" not in plan and "cong\\s*vien" not in plan


def test_records_read_twice_are_joined_once(spark, sf_dir, monkeypatch):
    from landlens.catalog import scans
    from landlens.sources.listings import raw_listings

    once = raw_listings(spark, sf_dir, staged=True)
    assert all("listing-base" in x for x in once.inputFiles())
    assert once.exceptAll(raw_listings(spark, sf_dir)).count() == 0 and once.count() == raw_listings(spark, sf_dir).count()
    read = []
    monkeypatch.setattr(scans.S, "write_csv", lambda df, *args, **options: read.append(df.inputFiles()))
    monkeypatch.setattr(scans.S, "read_csv", lambda *args: None)
    scans._written_csv(spark, sf_dir, append=True)
    assert len(read) == 2 and all("listing-base" in x for files in read for x in files)


def test_fact_rows_are_moved_once(spark, sf_dir, capsys):
    """Whole rows pass the dedup's shuffle alone; keys and ids are numbered without them, and listings stay as they were."""
    from landlens.catalog.frames import clean
    from landlens.operators.clean import with_classes

    star = S.build_star(clean(spark, sf_dir, S.FACT_INPUT, staged=True), stage=False)
    star["fact"].explain(mode="formatted")
    moved = [x for x in capsys.readouterr().out.split("\n\n") if re.match(r"\(\d+\) Exchange", x.strip())]
    assert [x for x in moved if "unit_price#" in x] == []
    assert sum("valueWithExtremumOrdering" in x for x in moved) == 1
    whole = clean(spark, sf_dir)
    plain = S.deduplicated(whole)
    for dim, keys, name in (("location", S.LOCATION, "location_skey"), ("features", S.FEATURES, "feature_skey"), ("details", S.DETAILS_JOIN, "status_skey"), ("product_keys", ["product_id"], "product_skey")):
        plain = S.null_safe_lookup(plain, star[dim], keys, [name])
    plain = S.with_risk_flags(plain.select(*S.FACT))
    assert star["fact"].drop("listing_id").exceptAll(plain).count() == 0 and plain.count() == star["fact"].count()
    ids = star["fact"].agg({"listing_id": "max"}).first()[0]
    assert ids == star["fact"].select("listing_id").distinct().count() == plain.count()
    some = S.build_star(whole, columns=["product_skey", "posted_date", "area"])["fact"]
    assert some.columns == ["product_skey", "posted_date", "area", "listing_id"] and some.count() == plain.count()
    assert with_classes(whole).exceptAll(whole).count() == 0


def test_a_page_version_is_extracted_once(spark, tmp_path, monkeypatch):
    """Of deliveries that repeat address and text one is extracted, over all batches; versions that differ in either all are."""
    rows = [(1, "u1", "h"), (2, "u1", "h2"), (3, "u1", None), (4, None, "u1"), (5, None, None), (6, "", ""), (7, "u", "1h"), (8, None, "")]
    pages = spark.createDataFrame(rows, I.PAGE_SCHEMA).coalesce(1)
    for _ in range(2):
        pages.write.mode("append").parquet(str(tmp_path / "in"))
    reached = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda url: reached.add(1) or "bad", "string").asNondeterministic()
    monkeypatch.setattr(I, "extract_listings", lambda df, site, as_of: df.withColumn("reject_reason", seen("url")))
    I.ingest_pages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at"), SITE, F.current_date(), max_files=1).awaitTermination()
    assert reached.value == len(rows)
    assert I.read_rejects(spark, str(tmp_path / "out")).count() == len({url for _, url, _ in rows})
    assert I.first_versions(pages.union(pages)).count() == len(rows)
