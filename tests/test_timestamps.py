from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from webloom.operators import timestamps as ts

CASES = [
    ("2025-11-30T09:51:58Z", "DMY", "Europe/Berlin", "2025-11-30T09:51:58.000000Z"),
    ("2025-08-14", "YMD", "Asia/Kolkata", "2025-08-13T18:30:00.000000Z"),
    ("2025-03-12 12:23 CET", "DMY", "Europe/Berlin", "2025-03-12T11:23:00.000000Z"),
    ("2024-10-27 02:30", "DMY", "Europe/Berlin", "2024-10-27T00:30:00.000000Z"),
    ("2024-10-27 02:30 CET", "DMY", "Europe/Berlin", "2024-10-27T01:30:00.000000Z"),
    ("CST", "DMY", "America/Chicago", None),
    ("November 3, 2024 1:30 AM CST", "MDY", "America/Chicago", "2024-11-03T07:30:00.000000Z"),
    ("20251024T014600Z", "DMY", "UTC", "2025-10-24T01:46:00.000000Z"),
    ("1679802561737", "DMY", "Asia/Kolkata", "2023-03-26T03:49:21.737000Z"),
    ("1714898003", "DMY", "Asia/Kolkata", "2024-05-05T08:33:23.000000Z"),
    ("09.17.2025 8:03 PM", "MDY", "UTC", "2025-09-17T20:03:00.000000Z"),
    ("04-02-25 06:52", "DMY", "UTC", "2025-02-04T06:52:00.000000Z"),
    ("25/02/04 06:52", "YMD", "UTC", "2025-02-04T06:52:00.000000Z"),
    ("2025-05-27 14:43 Europe/Paris", "DMY", "UTC", "2025-05-27T12:43:00.000000Z"),
    ("2023-01-15 00:49 America/Los_Angeles", "DMY", "UTC", "2023-01-15T08:49:00.000000Z"),
    ("2024-12-22T02:29:44-05:00[America/New_York]", "DMY", "UTC", "2024-12-22T07:29:44.000000Z"),
    ("2025-05-19T08:46:12.117+0530", "DMY", "UTC", "2025-05-19T03:16:12.117000Z"),
    ("Mon, 18 Mar 2024 06:31:01 +0000", "DMY", "UTC", "2024-03-18T06:31:01.000000Z"),
    ("25. September 2024, 08:35 Uhr", "DMY", "Europe/Berlin", "2024-09-25T06:35:00.000000Z"),
    ("20 de novembro de 2023 às 08:31", "DMY", "Europe/Lisbon", "2023-11-20T08:31:00.000000Z"),
    ("30 janvier 2024 à 18h45", "DMY", "Europe/Paris", "2024-01-30T17:45:00.000000Z"),
    ("22 августа 2025 г., 15:46", "DMY", "Europe/Moscow", "2025-08-22T12:46:00.000000Z"),
    ("Jan 28, 2025 at 12:28 AM", "MDY", "UTC", "2025-01-28T00:28:00.000000Z"),
    ("10 października 2025, 21:16", "DMY", "UTC", "2025-10-10T21:16:00.000000Z"),
    ("31.02.2025 10:00", "DMY", "UTC", None),
    ("2025-13-41", "DMY", "UTC", None),
    ("2024-02-30T08:00:00Z", "DMY", "UTC", None),
    ("0000-00-00 00:00:00", "DMY", "UTC", None),
    ("3 hours ago", "DMY", "UTC", None),
    ("{{ date }}", "DMY", "UTC", None),
    ("yesterday", "DMY", "UTC", None),
    ("13:99 PM", "DMY", "UTC", None),
    ("2025-05-27 14:43 Nowhere/City", "DMY", "UTC", None),
    ("", "DMY", "UTC", None),
    (None, "DMY", "UTC", None),
]


def settings(spark, zones):
    rows = [(2 * i, i, "SITE_TIMEZONE", z) for i, (z, _) in enumerate(zones) if z] + [(2 * i + 1, i, "DATE_ORDER", o) for i, (_, o) in enumerate(zones)]
    return spark.createDataFrame(rows, "id BIGINT, spider_id BIGINT, key STRING, value STRING")


def test_cases(spark):
    rows = spark.createDataFrame([(i, i, c[0], "x") for i, c in enumerate(CASES)], "n BIGINT, spider_id BIGINT, published_date STRING, _local STRING").drop("_local")
    out = ts.normalise_published(rows, settings(spark, [(c[2], c[1]) for c in CASES]))
    got = {r.n: r.utc for r in out.collect()}
    assert [got[i] for i in range(len(CASES))] == [c[3] for c in CASES]


def test_repeats_nulls_and_empty(spark):
    rows = spark.createDataFrame([(1, 7, "2025-01-01"), (1, 7, "2025-01-01"), (2, None, "2025-01-01"), (3, 99, None)], "n INT, spider_id BIGINT, published_date STRING")
    out = ts.normalise_published(rows, settings(spark, [("Asia/Kolkata", "DMY")]))
    assert sorted((r.n, r.utc or "") for r in out.collect()) == [(1, "2025-01-01T00:00:00.000000Z")] * 2 + [(2, "2025-01-01T00:00:00.000000Z"), (3, "")]
    assert ts.normalise_published(rows.limit(0), settings(spark, [])).count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Australia/Sydney", "Asia/Kolkata"])
def test_estimated_history(spark, zone):
    """The zone is found from ingestion times, over daylight-saving changes, although
    some rows are ingested months late."""
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for n in range(600):
        instant = start + timedelta(hours=29 * n)
        late = timedelta(days=90) if n % 9 == 0 else timedelta(minutes=7 * (n % 40) + 1)
        rows.append((1, instant.astimezone(ZoneInfo(zone)).replace(tzinfo=None), (instant + late).replace(tzinfo=None)))
    df = spark.createDataFrame(rows, "s INT, _local TIMESTAMP_NTZ, got TIMESTAMP_NTZ")
    zones = ["UTC", "America/New_York", "America/Chicago", "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata", "Pacific/Auckland"]
    found = ts.estimate_zones(df, "s", "_local", "got", spark.createDataFrame([(1, z) for z in zones], "s INT, _zone STRING")).collect()
    assert [(r._zone, r.violations) for r in found] == [(zone, 0)]


def test_spiders_with_several_zones_take_the_best(spark):
    rows = [(1, (datetime(2024, 3, 1) + timedelta(hours=n)).strftime("%Y-%m-%d %H:%M"), datetime(2024, 3, 1) + timedelta(hours=n - 5, minutes=30)) for n in range(50)]
    df = spark.createDataFrame(rows, "spider_id BIGINT, published_date STRING, scraped_at TIMESTAMP_NTZ")
    several = spark.createDataFrame([(1, 1, "SITE_TIMEZONE", "UTC"), (2, 1, "SITE_TIMEZONE", "Asia/Kolkata")], "id BIGINT, spider_id BIGINT, key STRING, value STRING")
    first = ts.normalise_published(df, several, ingested="scraped_at").orderBy("published_date").first()
    assert first.utc == "2024-02-29T18:30:00.000000Z"


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "Europe/Berlin"])
def test_estimated_among_all_histories(spark, zone):
    """Without any setting nearly all zone-less times get their instants back."""
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows, want = [], {}
    for n in range(500):
        instant = start + timedelta(hours=31 * n)
        want[n] = instant.strftime("%Y-%m-%dT%H:%M:00.000000Z")
        rows.append((n, 5, instant.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M"), (instant + timedelta(minutes=3 * (n % 50))).replace(tzinfo=None)))
    rows += [(900, 5, None, None), (901, 5, "", start.replace(tzinfo=None)), (902, 5, "2024-02-31 10:00", start.replace(tzinfo=None)), (903, None, "2024-02-01 10:00", start.replace(tzinfo=None)), (904, 5, "2024-02-01T10:00Z", start.replace(tzinfo=None))]
    df = spark.createDataFrame(rows, "n BIGINT, spider_id BIGINT, published_date STRING, scraped_at TIMESTAMP_NTZ")
    known = settings(spark, [(None, "DMY")] * 6)
    instants, sources = ts.estimated(df, known)
    got = {r.n: r.utc for r in instants.collect()}
    assert set(got) == set(want) and sum(got[n] == want[n] for n in want) >= 0.98 * len(want)
    assert [(r.spider_id, r.configured, r["rows"]) for r in sources.collect()] == [(5, "UTC", 500)]
    assert ts.estimated(df.limit(0), known)[0].count() == 0


def test_abbreviations_of_distant_years(spark):
    rows = spark.createDataFrame([(1, 0, "1935-03-12 12:00 EST"), (2, 0, "2080-03-01 12:00 EST")], "n INT, spider_id BIGINT, published_date STRING")
    out = ts.normalise_published(rows, settings(spark, [("America/New_York", "DMY")]))
    assert sorted((r.n, r.utc) for r in out.collect()) == [(1, "1935-03-12T17:00:00.000000Z"), (2, "2080-03-01T17:00:00.000000Z")]
