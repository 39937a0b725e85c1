"""Registered queries do the operators' whole default job."""

from __future__ import annotations

from tessera.operators import forecast
from tessera.plans import queries


def test_backtest_intervals_take_all_resamples(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "_backtest", lambda spark, sf_dir: None)
    monkeypatch.setattr(queries, "rounded", lambda df: df)
    monkeypatch.setattr(forecast, "summarize", lambda tested, models=forecast.BASELINES, resamples=forecast.RESAMPLES: asked.append(resamples))
    queries.QUERIES["backtest_intervals"](spark, "")
    assert asked == [forecast.RESAMPLES] == [500]


def test_names_of_whole_texts(spark, tmp_path):
    import hashlib

    text = "Ab c" * 100 + "é!"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = queries.QUERIES["name_normalize"](spark, str(tmp_path)).first()
    assert (row.n_chars, row.name_sha256) == (301, hashlib.sha256(("abc" * 100 + "e").encode()).hexdigest())
