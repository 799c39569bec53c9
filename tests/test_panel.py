from datetime import date

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import to_wide
from tideline.operators import panel
from tideline.operators.resample import resample
from tideline.sources.files import read_series, read_weights, write_series, write_weights
from tideline.sources.sheet import pair_schema, read_pair_sheet, unpivot_pairs


def test_alignment_drops_weekends_and_fills_the_calendar(make):
    # 2021-01-02 is a Saturday.
    obs = make([("x", "2021-01-01", 1.0), ("x", "2021-01-02", 9.0), ("x", "2021-01-06", 2.0), ("y", "2021-01-05", 5.0)])
    rows = panel.clean_prices(obs, "2021-01-01", "2021-01-07").orderBy("asset", "date").collect()
    assert [(r.asset, r.date.day, r.price) for r in rows] == [
        ("x", 1, 1.0), ("x", 4, None), ("x", 5, None), ("x", 6, 2.0), ("x", 7, None),
        ("y", 1, None), ("y", 4, None), ("y", 5, 5.0), ("y", 6, None), ("y", 7, None),
    ]


def test_assets_without_usable_observation_keep_their_rows(make):
    obs = make([("w", "2021-01-02", 3.0), ("w", "2021-01-03", 3.0), ("n", "2021-01-04", None), ("n", None, 4.0),
                ("o", "2020-01-06", 1.0), ("o", "2022-01-05", 1.0), ("nan", "2021-01-04", float("nan"))])
    rows = panel.clean_prices(obs, "2021-01-01", "2021-01-05").collect()
    assert sorted((r.asset, r.date.day) for r in rows) == sorted(
        (a, d) for a in ("w", "n", "o", "nan") for d in (1, 4, 5)
    )
    assert all(r.price is None for r in rows)


def test_off_calendar_rows_around_prices_add_nothing(make):
    obs = make([("x", "2021-01-01", 1.0), ("x", "2021-01-02", 9.0), ("x", "2021-01-03", 9.0), ("x", "2021-01-04", None),
                ("x", "2021-01-05", 2.0), ("x", "2020-12-25", 7.0)])
    rows = panel.clean_prices(obs, "2021-01-01", "2021-01-06").orderBy("date").collect()
    assert [(r.date.day, r.price) for r in rows] == [(1, 1.0), (4, None), (5, 2.0), (6, None)]


def test_duplicate_observations_are_rejected(make):
    obs = make([("x", "2021-01-04", 1.0), ("x", "2021-01-04", 2.0)])
    with pytest.raises(PySparkException, match="duplicate observation of x"):
        panel.clean_prices(obs, "2021-01-01", "2021-01-07").collect()


def test_panel_matches_a_reindex(observations, panel_df):
    raw = observations.toPandas()
    days = pd.bdate_range("2015-01-01", "2019-12-31")
    expected = raw.assign(date=pd.to_datetime(raw["date"])).pivot(index="date", columns="asset", values="price").reindex(days)
    pd.testing.assert_frame_equal(to_wide(panel_df, "price"), expected, check_names=False, check_freq=False)


def test_calendar_and_fill(make):
    obs = make([("x", "2020-02-27", 1.0), ("x", "2020-03-03", 4.0)])
    assert [r.date.day for r in panel.business_calendar(obs).orderBy("date").collect()] == [27, 28, 2, 3]
    filled = panel.ffill(panel.clean_prices(obs, "2020-02-26", "2020-03-04")).orderBy("date").collect()
    assert [r.px for r in filled] == [None, 1.0, 1.0, 1.0, 4.0, 4.0]


def test_complete_cases_and_tail(make):
    obs = make([("x", "2021-01-04", 1.0), ("x", "2021-01-05", 2.0), ("y", "2021-01-05", 3.0), ("y", "2021-01-06", 4.0)])
    p = panel.clean_prices(obs, "2021-01-04", "2021-01-06")
    assert {(r.asset, r.date.day) for r in panel.complete_cases(p).collect()} == {("x", 5), ("y", 5)}
    last = panel.tail(panel.wide(p, ["x", "y"]), 2).collect()
    assert [(r.date.day, r.x, r.y) for r in last] == [(6, None, 4.0), (5, 2.0, 3.0)]
    assert {r.asset for r in panel.asset_subset(p, ["y"]).collect()} == {"y"}
    assert panel.between_years(p, 2020, 2020).count() == 0 and panel.between_years(p, 2021, 2021).count() == 6


@pytest.mark.parametrize("chunk", [2, 3, 1000])
def test_quality_counts_do_not_depend_on_the_slices(spark, chunk):
    days = [4, 5, 5, 3, 6, 2, 7, 8, 1]
    rows = [("x", date(2021, 1, d), None if d == 7 else 1.0, k) for k, d in enumerate(days)]
    obs = spark.createDataFrame(rows, "asset string, date date, price double, seq bigint")
    r = panel.series_quality(obs, chunk=chunk).first()
    assert (r.n_rows, r.n_null, r.n_off_calendar, r.n_duplicate, r.n_backward) == (9, 1, 2, 1, 3)
    assert not r.is_monotonic and r.first_date == date(2021, 1, 1)


def test_pair_sheet_round_trip(spark, tmp_path):
    sheet = spark.createDataFrame(
        [("2021-01-04", 1.0, "2021-01-05", 5.0), ("2021-01-05", 2.0, None, None), ("bad", 3.0, None, None)],
        pair_schema(["x", "y y"]),
    )
    sheet.coalesce(1).write.option("header", True).csv(str(tmp_path / "sheet"))
    for source in (sheet, read_pair_sheet(spark, str(tmp_path / "sheet"), ["x", "y y"])):
        rows = {(r.asset, str(r.date), r.price) for r in unpivot_pairs(source, "yyyy-MM-dd").collect()}
        assert rows == {("x", "2021-01-04", 1.0), ("x", "2021-01-05", 2.0), ("x", "None", 3.0), ("y y", "2021-01-05", 5.0)}
    with pytest.raises(ValueError):
        unpivot_pairs(sheet.drop("date1"))


def test_weight_files(spark, tmp_path):
    for name, text in {"p": "x,0.25\r\ny,0.75\r\n", "q": "x,1.0\r\ny,0.0\r\n"}.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    weights = read_weights(spark, {n: str(tmp_path / f"{n}.csv") for n in ("p", "q")})
    expected = {("p", "x", 0.25), ("p", "y", 0.75), ("q", "x", 1.0), ("q", "y", 0.0)}
    assert {tuple(r) for r in weights.collect()} == expected
    write_weights(weights, str(tmp_path / "out"))
    again = read_weights(spark, {n: str(tmp_path / "out" / f"portfolio={n}") for n in ("p", "q")})
    assert {tuple(r) for r in again.collect()} == expected


def test_series_files(panel_df, spark, tmp_path):
    write_series(panel_df.select("asset", "date", "price"), str(tmp_path / "series"))
    assert len(list((tmp_path / "series" / "asset=a1").glob("*.parquet"))) == 1
    back = read_series(spark, str(tmp_path / "series"))
    assert back.count() == panel_df.count()
    assert back.where("asset = 'a1'").count() == panel_df.where("asset = 'a1'").count()


@pytest.mark.parametrize("freq, rule", [("weekly", "W"), ("monthly", "ME"), ("quarterly", "QE"), ("annual", "YE")])
def test_resampling_matches_pandas_with_empty_periods(spark, make, freq, rule):
    days = ["2019-01-30", "2019-01-31", "2019-02-04", "2019-09-30", "2019-10-01", "2022-03-31", "2022-12-31"]
    df = make([("x", d, float(k * k + 1)) for k, d in enumerate(days)])
    got = resample(df, freq, mean=F.avg("price")).orderBy("date").toPandas()
    series = pd.Series([float(k * k + 1) for k in range(len(days))], index=pd.to_datetime(days))
    expected = series.resample(rule).mean()
    assert list(pd.to_datetime(got["date"])) == list(expected.index)
    pd.testing.assert_series_equal(got["mean"], expected.reset_index(drop=True), check_names=False)


def test_observations_outside_the_panel_are_an_error_if_asked(make):
    obs = make([("x", "2021-01-05", 1.0), ("x", "2021-02-01", 2.0), ("y", "2021-01-30", 3.0)])
    assert panel.clean_prices(obs, "2021-01-04", "2021-01-08").count() == 10
    with pytest.raises(Exception, match="observation outside the panel: x on 2021-02-01"):
        panel.clean_prices(obs, "2021-01-04", "2021-01-08", strict=True).collect()
    # A weekend is on no business calendar.
    assert panel.clean_prices(obs, "2021-01-04", "2021-02-01", strict=True).count() == 42


def test_assets_without_a_column_are_an_error(make):
    p = panel.clean_prices(make([("x", "2021-01-05", 1.0), ("new", "2021-01-05", 2.0)]), "2021-01-04", "2021-01-08")
    with pytest.raises(Exception, match="asset without a column: new"):
        panel.wide(p, ["x"]).collect()
    assert panel.wide(panel.asset_subset(p, ["x"]), ["x"]).count() == 5
