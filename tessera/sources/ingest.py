"""Fetching raw pages from the three public APIs. Driver-side I/O; the transport is a parameter."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from pathlib import Path

from tessera.sources.dimensions import indicator_rows
from tessera.sources.snapshot import RawPage, SnapshotWriter

Get = Callable[[str], RawPage]

WHO_API = "https://ghoapi.azureedge.net/api"
WORLDBANK_API = "https://api.worldbank.org/v2"
UNICEF_API = "https://sdmx.data.unicef.org/ws/public/sdmxapi/rest/data"


class FetchError(Exception):
    """A response that isn't what the API promises."""


def http_get(url: str, attempts: int = 4, timeout: float = 60.0, wait: float = 1.0, opener=urllib.request.urlopen, sleep=time.sleep) -> RawPage:
    """GET with retries and growing pauses on connection errors, 429 and 5xx."""
    for attempt in range(attempts):
        try:
            with opener(urllib.request.Request(url, headers={"Accept": "*/*"}), timeout=timeout) as response:
                return RawPage(url, response.status, response.headers.get("Content-Type", ""), response.read())
        except urllib.error.HTTPError as e:
            if (e.code != 429 and e.code < 500) or attempt == attempts - 1:
                raise
        except OSError:
            if attempt == attempts - 1:
                raise
        sleep(wait * 2**attempt)
    raise FetchError(url)


def fetch_who(get: Get, series: str, countries: list[str], years: tuple[int, int]) -> Iterator[RawPage]:
    quoted = ",".join(f"'{c}'" for c in countries)
    where = f"SpatialDim in ({quoted}) and TimeDim ge {years[0]} and TimeDim le {years[1]}"
    url: str | None = f"{WHO_API}/{series}?" + urllib.parse.urlencode({"$filter": where})
    while url:
        page = get(url)
        payload = json.loads(page.content)
        if "value" not in payload:
            raise FetchError(f"no rows in {url}")
        yield page
        url = payload.get("@odata.nextLink")


def fetch_worldbank(get: Get, series: str, countries: list[str], years: tuple[int, int], per_page: int = 1000) -> Iterator[RawPage]:
    number, last = 1, 1
    while number <= last:
        query = urllib.parse.urlencode({"format": "json", "date": f"{years[0]}:{years[1]}", "per_page": per_page, "page": number})
        page = get(f"{WORLDBANK_API}/country/{';'.join(countries)}/indicator/{series}?{query}")
        payload = json.loads(page.content)
        if not isinstance(payload, list) or len(payload) < 2:  # errors come with status 200
            raise FetchError(f"no rows in {page.url}")
        last = int(payload[0].get("pages") or 1)
        yield page
        number += 1


def fetch_unicef(get: Get, series: str, countries: list[str], years: tuple[int, int]) -> Iterator[RawPage]:
    flow, indicator = series.split(".", 1)
    query = urllib.parse.urlencode({"startPeriod": years[0], "endPeriod": years[1], "format": "csv"})
    page = get(f"{UNICEF_API}/UNICEF,{flow},1.0/{'+'.join(countries)}.{indicator}?{query}")
    if b"REF_AREA" not in page.content.split(b"\n", 1)[0]:
        raise FetchError(f"no header in {page.url}")
    yield page


FETCHERS: dict[str, Callable[..., Iterable[RawPage]]] = {"who": fetch_who, "worldbank": fetch_worldbank, "unicef": fetch_unicef}
_SERIES = {"who": "who_series", "worldbank": "worldbank_series", "unicef": "unicef_series"}


def run_ingestion(out_dir: str, countries: list[str], years: tuple[int, int], sources: Iterable[str] = tuple(FETCHERS), concepts: Iterable[str] | None = None, get: Get = http_get, run_id: str | None = None, pause: float = 0.5, sleep=time.sleep) -> Path:
    """One snapshot of all series. A series is written whole or recorded as failed; the others go on."""
    wanted = [r for r in indicator_rows() if concepts is None or r["concept"] in set(concepts)]
    sources = list(sources)
    writer = SnapshotWriter(out_dir, run_id or datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ"), {"sources": sources, "concepts": [r["concept"] for r in wanted], "countries": countries, "years": list(years)})
    for source in sources:
        for row in wanted:
            try:
                pages = list(FETCHERS[source](get, row[_SERIES[source]], countries, years))
            except Exception as e:
                writer.record_failure(source, row["concept"], f"{type(e).__name__}: {e}")
            else:
                writer.write_pages(source, row[_SERIES[source]], row["concept"], pages)
            sleep(pause)
    return writer.finalize()
