"""Sources, sinks and streaming on small hand-made files (written to a per-test temp folder)."""

import os

import pytest
from pyspark.sql import functions as F

from lacuna.functions import constants as C
from lacuna.operators import normalize as N
from lacuna.sources import csv as CSV
from lacuna.sources import json_ingest as J
from lacuna.sources import tables as TB


def _write(tmp_path, name, text, bom=False):
    p = tmp_path / name
    p.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode("utf-8"))
    return str(p)


def test_csv_scan_bom_hxl_long_short_rows(spark, tmp_path):
    path = _write(tmp_path, "hno.csv", (
        "Country ISO3,Cluster,In Need,Population\n"
        "#country+code,#sector,#inneed,#population\n"
        'AFG,EDU,"1,200",100\n'
        "YEM,HEA,50,10,EXTRA\n"
        "SOM,ALL\n"
        "SYR,PRO,n/a,\n"
    ), bom=True)
    df = CSV.drop_hxl_rows(CSV.read_csv_strings(spark, path))
    assert df.columns[0] == "Country ISO3"
    rows = {r[0]: r for r in df.collect()}
    assert set(rows) == {"AFG", "SOM", "SYR"}  # long row dropped, short kept
    assert rows["SOM"]["In Need"] is None
    cand = C.HNO_COLUMN_CANDIDATES
    res = CSV.numeric(CSV.resolve_columns(df, cand, "ci"), ["in_need", "population"])
    # the code column matches the "country" candidates first (it holds codes);
    # tier 1 of the resolver then takes it as the ISO3
    res = N.resolve_iso3(res, "country", "country", out="iso3")
    got = {r.iso3: r for r in res.collect()}
    assert got["AFG"].in_need == 1200.0 and got["SYR"].in_need is None
    assert "sector" in res.columns


def test_needs_files_union_and_provenance(spark, tmp_path):
    a = _write(tmp_path, "a.csv", "country,sector,in need\nChad,Health,10\n")
    b = _write(tmp_path, "b.csv", "Country,Cluster,PIN,Targeted\nMali,EDU,5,2\n")
    df = CSV.read_needs_files(spark, {2024: a, 2025: b}, C.HNO_COLUMN_CANDIDATES)
    rows = sorted(df.select("country", "year", "in_need", "targeted", "source_file").collect())
    assert rows[0].country == "Chad" and rows[0].targeted is None and rows[0].source_file == "a.csv"
    assert rows[1].year == 2025 and rows[1].in_need == 5.0


def test_snake_case_and_drop(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x", "y")], "PaidAmt double, PaidAmtLocal double, PooledFundName string, DonorName string")
    out = CSV.snake_case_columns(CSV.drop_and_rename(df, C.CBPF_DROP_COLUMNS, C.CBPF_RENAME))
    assert out.columns == ["paid_amt_u_s_d", "pooled_fund_name", "donor_name"]
    pf = N.pooled_fund_iso3(spark.createDataFrame([("Afghanistan HF",), ("Syria CHF",), ("Atlantis HF",)], "pooled_fund_name string"))
    assert {r.pooled_fund_name: r.country for r in pf.collect()} == {"Afghanistan HF": "AFG", "Syria CHF": "SYR", "Atlantis HF": "UNK"}


def test_response_plans_explode_years(spark):
    df = spark.createDataFrame([("p1", "Plan", " afg ", "Active", "1,000", "10", "2023-01-01", "2025-12-31"),
                                ("p2", "Plan", "YEM", "Active", "5", "1", "2024", None)],
                               "plan_id string, plan_name string, iso3 string, status string, requirements_usd string, funding_usd string, year_start string, year_end string")
    out = CSV.response_plans(df)
    assert sorted((r.iso3, r.year) for r in out.collect()) == [("AFG", 2023), ("AFG", 2024), ("AFG", 2025), ("YEM", 2024)]


def test_composite_severity(spark):
    base = spark.createDataFrame([("A", 2024), ("B", 2024)], "iso3 string, year int")
    s1 = spark.createDataFrame([("A", 2024, 6.0), ("B", 2024, 4.0)], "iso3 string, year int, value double")
    s2 = spark.createDataFrame([("A", 2024, 9.0)], "iso3 string, year int, value double")
    out = {r.iso3: r.composite_severity for r in CSV.composite_severity(base, {"inform": (s1, 2.0), "ipc": (s2, 1.0)}).collect()}
    assert out["A"] == pytest.approx((12 + 9) / 3) and out["B"] == pytest.approx(4.0)


def test_json_ingest_fences_and_errors(spark):
    replies = spark.createDataFrame([
        (1, '```json\n{"country_region": "Chad", "estimated_people_in_need": 5, "sectors_assessed": ["Health"]}\n```', "u1"),
        (2, '{"error": "could not parse"}', "u2"),
        (3, "not json at all", "u3"),
    ], "id int, reply string, url string")
    good, bad = J.parse_records(replies, "reply", J.ASSESSMENT_SCHEMA, source_col="url")
    g = good.collect()
    assert len(g) == 1 and g[0].country_region == "Chad" and g[0].sectors_assessed == ["Health"] and g[0].source_url == "u1"
    assert sorted(r.id for r in bad.collect()) == [2, 3]


def test_sinks_and_export(spark, tmp_path):
    TB.init_schemas(spark, prefix="t_")
    name = f"t_gold.sample_{os.getpid()}"
    df = spark.createDataFrame([("a", 1.5, None)], "s string, x double, n string")
    assert TB.write_table(df, name)
    assert TB.write_table(df.limit(0), name) is False  # empty frame keeps the old table
    assert spark.table(name).count() == 1
    assert TB.scalar(spark.table(name).select("x")) == 1.5
    assert TB.table_or_empty(spark, "t_gold.missing", df.schema).count() == 0
    out = str(tmp_path / "export")
    TB.export_csv(spark.createDataFrame([('Say "hi"', 2.0, None)], "s string, x double, n string"), out, single_file=True)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert text.splitlines() == ['"s","x","n"', '"Say ""hi""",2.0,""']


def test_export_is_the_text_of_the_reference_format(spark, tmp_path):
    """Header names, texts and missing cells quoted, numbers bare and as short as Python writes them; a header for an empty frame."""
    import csv
    import io

    import pandas as pd

    x = [1.5, 1e7, 12345678.9, 1e15, 1e16, 1.2345678901234567e16, 1e-3, 1.234e-4, 1e-4, 1e-5, 1.5e-7, 1e100, 0.1, -2.5e-5, 123456789012345.6, 0.00012345678901234567, None, float("nan"), -0.0, float("inf")]
    s = ['Say "hi"', None, "a,b", "l1\nl2"] + ["t"] * (len(x) - 4)
    rows = [(a, b, i - 3, i % 2 == 0) for i, (a, b) in enumerate(zip(s, x))]
    name = 'a "quoted", name'
    want = io.StringIO()
    pd.DataFrame(rows, columns=[name, "x", "n", "b"]).fillna("").to_csv(want, index=False, quoting=csv.QUOTE_NONNUMERIC)
    df = spark.createDataFrame(rows, f"`{name}` string, x double, n int, b boolean")
    read = lambda out: "".join(open(os.path.join(out, f), newline="").read() for f in os.listdir(out) if f.endswith(".csv"))
    TB.export_csv(df.coalesce(1), str(tmp_path / "a"), single_file=True)
    assert read(str(tmp_path / "a")) == want.getvalue()
    TB.export_csv(df.limit(0), str(tmp_path / "b"))
    assert read(str(tmp_path / "b")) == '"a ""quoted"", name","x","n","b"\n'


def test_quoted_cells_are_read_whole(spark, tmp_path):
    """Doubled quotes, commas and line breaks inside quotes, surplus and missing cells: what pandas reads as strings."""
    import pandas as pd

    text = (
        'id,a,"b ""q"", x"\n1,"x ""y"", z",u\n2,"two\nlines"\n3,"q ""end""",,\n4,"a,b","c\nd",e\n5,"only "" quote",""\n'
        '6,x\\,y\n7,"p\\",q\n8, lead , trail \n\n9,"multi\nline ""q"" , c",w'
    )
    path = _write(tmp_path, "q.csv", text, bom=True)
    got = CSV.read_csv_strings(spark, path)
    want = pd.read_csv(path, on_bad_lines="skip", dtype=str, encoding="utf-8-sig").astype(object)
    want = want.where(want.notna(), None)
    assert got.columns == list(want.columns) and got.count() == len(want)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.values.tolist()))
    lines = spark.createDataFrame([('1,"x ""y"", z"',), ('2,"a\nb",c',), ('3,"q",,',), ("#t,x",)], "value string")
    assert sorted(map(tuple, CSV.read_csv_rows(lines, ["i", "a", "b"], True).collect())) == [("1", 'x "y", z', None), ("2", "a\nb", "c")]
    plain = _write(tmp_path, "p.csv", "a,b\n1,2\n3\n4,5,6\n")
    assert sorted(map(tuple, CSV.read_csv_strings(spark, plain, multi_line=False).collect())) == [("1", "2"), ("3", None)]
    assert CSV.read_header(spark, _write(tmp_path, "e.csv", "")) == []


def test_overwrite_only_changed_partitions(spark):
    """Upserts and deletes in place: files of other partitions keep name, length and time; nulls in keys and partitions; emptied partitions go."""
    name = f"inplace_{os.getpid()}"
    rows = [(i, None if i % 10 == 9 else 2000 + i % 5, f"old{i}") for i in range(100)] + [(None, 2001, "null id")]
    df = spark.createDataFrame(rows, "id int, year int, v string").select("id", "v", "year")
    df.repartition("year").write.partitionBy("year").mode("overwrite").saveAsTable(name)

    def files():
        out = {}
        for f in spark.table(name).inputFiles():
            path = f.removeprefix("file://").removeprefix("file:")
            out[path] = (os.path.getsize(path), os.path.getmtime(path))
        return out

    try:
        before = files()
        ups = spark.createDataFrame([(1, "new1", 2001), (1, "new1", 2001), (500, "added", 2001), (None, "new null", 2001), (9, "new9", None)], "id int, v string, year int")
        gone = spark.createDataFrame([(i, 2003) for i in range(3, 100, 5)], "id int, year int")
        assert TB.overwrite_partitions(ups, name, ["id", "year"], deletes=gone) == [None, 2001, 2003]
        want = {(i, y): v for i, y, v in rows if y != 2003} | {(1, 2001): "new1", (500, 2001): "added", (None, 2001): "new null", (9, None): "new9"}
        got = spark.table(name).collect()
        assert len(got) == len(want) and {(r.id, r.year): r.v for r in got} == want
        after = files()
        for year in (2000, 2002, 2004):
            own = {f: s for f, s in before.items() if f"year={year}" in f}
            assert own and own == {f: s for f, s in after.items() if f"year={year}" in f}
        assert TB.overwrite_partitions(ups.limit(0), name, ["id", "year"]) == []
        with pytest.raises(ValueError):
            TB.overwrite_partitions(ups, name, ["id"])
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_quality_observe(spark):
    from lacuna.operators import quality as Q

    df = spark.createDataFrame([(-1, 0.0), (5, 10.0)], "people_in_need long, requirements_usd double")
    observed, obs = Q.rule_metrics(df, Q.warn_rules())
    observed.count()
    assert obs.get == {"people_negative": 1, "requirements_not_positive": 1}


def test_streaming_attention_equals_batch(spark, tmp_path):
    from lacuna.sources import testdata as TD
    from lacuna.streaming.attention import start_attention_stream, windowed_counts

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    events = TD.read_table(spark, sf, "events")
    nations = TD.nations(spark, sf)
    landing = str(tmp_path / "landing")
    events.repartition(3).write.parquet(landing)
    q = start_attention_stream(spark, landing, nations, str(tmp_path / "sink"), str(tmp_path / "ckpt"),
                               length="1 day", slide="1 day", watermark="0 seconds", schema=events.schema)
    q.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "sink"))
    batch = windowed_counts(events, nations, "1 day", "1 day")
    # append mode emits windows once the watermark passes them; the last open window is not final yet
    last = batch.agg(F.max("window_start")).first()[0]
    exp = sorted(tuple(r) for r in batch.where(F.col("window_start") < last).collect())
    got = sorted(tuple(r) for r in streamed.select("iso3", "window_start", "window_end", "article_count").collect())
    assert got == exp


def test_incremental_load_loses_and_doubles_nothing(spark, tmp_path):
    """Rows a year late, the same key in one batch, across batches and as null; replayed batches; plans that read few columns."""
    from lacuna.streaming import ingest

    schema = "id long, ts timestamp, v string"
    landing, sink, state = (str(tmp_path / n) for n in ("land", "bronze", "state"))

    def land(rows):
        spark.createDataFrame(rows, "id long, ts string, v string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(landing)

    def load():
        stream = ingest.start_incremental_load(spark, landing, spark.createDataFrame([], schema).schema, ["id"], "ts", sink, state, files_per_batch=1)
        stream.awaitTermination(120)
        return sorted(((r.id, r.v) for r in ingest.loaded(spark, sink, spark.createDataFrame([], schema).schema).collect()), key=str)

    assert ingest.loaded(spark, sink, spark.createDataFrame([], schema).schema).count() == 0
    land([(1, "2024-06-01 00:00:00", "a"), (1, "2024-06-01 00:00:00", "a"), (2, "2024-06-01 01:00:00", "b"), (None, "2024-06-01 00:00:00", "n")])
    assert load() == [(1, "a"), (2, "b"), (None, "n")]
    land([(3, "2023-01-01 00:00:00", "late"), (2, "2024-06-01 01:00:00", "b"), (None, "2024-07-01 00:00:00", "n"), (1, "2025-06-01 00:00:00", "other time"), (4, None, "no time")])
    land([(5, "2024-06-01 00:00:00", "x"), (4, "2024-06-02 00:00:00", "again")])
    assert load() == [(1, "a"), (2, "b"), (3, "late"), (4, "no time"), (5, "x"), (None, "n")]
    assert load() == [(1, "a"), (2, "b"), (3, "late"), (4, "no time"), (5, "x"), (None, "n")]  # nothing new
    # the last batch comes again, as after a failure: with what it had written whole, or in part
    last = spark.createDataFrame([(5, "2024-06-01 00:00:00", "x"), (4, "2024-06-02 00:00:00", "again")], "id long, ts string, v string").withColumn("ts", F.to_timestamp("ts"))
    number = spark.read.parquet(sink).agg(F.max(ingest.BATCH)).first()[0]
    for _ in range(2):
        ingest.load_batch(last, number, ["id"], "ts", sink)
        rows = ingest.loaded(spark, sink, spark.createDataFrame([], schema).schema)
        assert sorted(((r.id, r.v) for r in rows.collect()), key=str) == [(1, "a"), (2, "b"), (3, "late"), (4, "no time"), (5, "x"), (None, "n")]


def test_layer_stages_write_tables(spark):
    from lacuna.plans.medallion import run

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    prefix = f"p{os.getpid()}_"
    t = run(spark, sf, "full", prefix)
    assert set(t) == {"bronze", "silver", "gold", "validate"}
    g = spark.table(f"{prefix}gold.crisis_index")
    assert g.count() == spark.table(f"{prefix}silver.funding").count() > 0
    assert spark.table(f"{prefix}gold.donor_concentration").count() == g.count()
