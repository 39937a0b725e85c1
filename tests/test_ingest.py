"""Fetching with a fake transport: paging, error payloads, retries, and failed series in the manifest."""

from __future__ import annotations

import io
import json
import urllib.error

import pytest

from tessera.plans.report import dictionary, markdown_table, render, undocumented
from tessera.sources import ingest
from tessera.sources.snapshot import RawPage


def page(url, payload, kind="application/json"):
    return RawPage(url, 200, kind, payload if isinstance(payload, bytes) else json.dumps(payload).encode())


def test_who_follows_links_and_checks_rows():
    answers = {"next": {"value": [2]}}
    get = lambda url: page(url, answers.get(url, {"value": [1], "@odata.nextLink": "next"}))
    assert len(list(ingest.fetch_who(get, "X", ["NGA"], (2000, 2001)))) == 2
    with pytest.raises(ingest.FetchError):
        list(ingest.fetch_who(lambda u: page(u, {"error": 1}), "X", ["NGA"], (2000, 2001)))


def test_worldbank_pages_and_error_payloads():
    pages = list(ingest.fetch_worldbank(lambda u: page(u, [{"pages": 3}, []]), "S", ["NGA"], (2000, 2001)))
    assert len(pages) == 3 and "page=3" in pages[2].url
    with pytest.raises(ingest.FetchError):
        list(ingest.fetch_worldbank(lambda u: page(u, [{"message": "bad"}]), "S", ["NGA"], (2000, 2001)))


def test_unicef_needs_a_header():
    assert len(list(ingest.fetch_unicef(lambda u: page(u, b"REF_AREA,X\n", "text/csv"), "A.B", ["NGA"], (2000, 2001)))) == 1
    with pytest.raises(ingest.FetchError):
        list(ingest.fetch_unicef(lambda u: page(u, b"<html>", "text/csv"), "A.B", ["NGA"], (2000, 2001)))


def test_retries_then_gives_up():
    calls, waits = [], []

    class Answer(io.BytesIO):
        status, headers = 200, {"Content-Type": "text/csv"}

    def opener(request, timeout):
        calls.append(1)
        if len(calls) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", None, None)
        return Answer(b"ok")

    assert ingest.http_get("http://x", opener=opener, sleep=waits.append).content == b"ok" and waits == [1.0, 2.0]

    def broken(request, timeout):
        raise urllib.error.HTTPError(request.full_url, 404, "no", None, None)

    with pytest.raises(urllib.error.HTTPError):
        ingest.http_get("http://x", opener=broken, sleep=waits.append)
    with pytest.raises(OSError):
        ingest.http_get("http://x", opener=lambda r, timeout: (_ for _ in ()).throw(OSError()), attempts=2, sleep=lambda s: None)


def test_a_failed_series_is_recorded_and_others_go_on(tmp_path):
    def get(url):
        if "worldbank" in url:
            raise OSError("down")
        return page(url, {"value": []}) if "gho" in url else page(url, b"REF_AREA\n", "text/csv")

    folder = ingest.run_ingestion(str(tmp_path), ["NGA"], (2000, 2001), concepts=["dtp3_coverage"], get=get, run_id="r", sleep=lambda s: None)
    manifest = json.loads((folder / "manifest.json").read_text())
    assert [f["source"] for f in manifest["files"]] == ["who", "unicef"] and manifest["failures"][0]["source"] == "worldbank"
    assert (folder / manifest["files"][1]["path"]).suffix == ".csv" and manifest["scope"]["countries"] == ["NGA"]


def test_reports(spark):
    df = spark.createDataFrame([(1, 0.123456, None), (2, 2.0, "a|b")], "n int, x double, s string")
    assert markdown_table(df).splitlines() == ["| n | x | s |", "|---|---|---|", "| 1 | 0.1235 |  |", "| 2 | 2 | a\\|b |"]
    assert render("T", [("S", df)]).startswith("# T\n\n## S\n\n| n |")
    assert "| x | double |" in dictionary({"t": df}, {"t": "note"}) and undocumented({"t": df, "u": df}, {"t": ""}) == ["u"]
