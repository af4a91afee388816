"""Mixed timestamp spellings to one UTC form.

Three steps, all JVM expressions:

1. ``parse_timestamps`` reads a string into local calendar fields and whatever
   zone the string itself names.
2. Each source gets the offset history (an IANA zone) that its zone-less strings
   follow. Candidates come from its settings, or, if wanted, from all IANA histories
   where it has none; of several the one with the fewest violations against the
   ingestion times wins (``estimate_zones``). ``estimated`` takes no settings at all.
3. ``to_utc`` converts. Of two possible instants the earlier is taken; a date
   alone means its first moment.

Defined results: null, empty and impossible strings, relative expressions and
other words give a null instant and stay in the output; an unknown zone name
gives null; repeated rows stay repeated; extra columns pass through.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.session import stored

# Month names (with their usual abbreviations and genitives) by number.
MONTHS = {
    1: "january jan januar januari janvier janv enero ene janeiro gennaio gen stycznia styczeń января январь янв",
    2: "february feb februar februari février févr febrero fevereiro fev febbraio lutego luty февраля февраль фев",
    3: "march mar märz mrz maart mrt mars marzo março marca marzec марта март",
    4: "april apr avril avr abril abr aprile kwietnia kwiecień апреля апрель апр",
    5: "may mai mei mayo maio maggio mag maja maj мая май",
    6: "june jun juni juin junio junho giugno giu czerwca czerwiec июня июнь июн",
    7: "july jul juli juillet juil julio julho luglio lug lipca lipiec июля июль июл",
    8: "august aug augustus août agosto ago sierpnia sierpień августа август авг",
    9: "september sep sept septembre septiembre setembro set settembre września wrzesień сентября сентябрь сен",
    10: "october oct oktober okt octobre octubre outubro out ottobre ott października październik октября октябрь окт",
    11: "november nov novembre noviembre novembro listopada listopad ноября ноябрь ноя",
    12: "december dec dezember dez décembre déc diciembre dic dezembro dicembre grudnia grudzień декабря декабрь дек",
}

_TIME = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([ap])\.?m\.?(?![a-z]))?"
_ZONE = r"(?: ?((?:utc|gmt)?[+-]\d{2}:?\d{2}|(?:utc|gmt)?[+-]\d{1,2}|[a-z]{1,5}|[a-z]+(?:/[a-z_+-]+)+))?(?:\[([a-z_/+-]+)\])?$"
_WEEKDAY = r"^(?:\p{L}+\.?,? )?"
_AT = r"(?:,? (?:às|à|at|um|om|alle|a las|o|в))?,?"
#: Each family's pattern and the order in which its groups give year, month, day
#: (three digits), then hour, minute, second, fraction, half of day, zone, bracket.
_SHAPES = (
    ("iso", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[t ,]+{_TIME})?{_ZONE}", "123"),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?()?{_ZONE}", "123"),
    ("numeric", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}})(?:[t ,]+{_TIME})?{_ZONE}", "123"),
    ("day first", rf"{_WEEKDAY}(\d{{1,2}})(?:\.|er|º|st|nd|rd|th)? (?:de )?(\p{{L}}+)\.?,? (?:del? )?(\d{{4}})(?:{_AT} {_TIME})?{_ZONE}", "321"),
    ("month first", rf"{_WEEKDAY}(\p{{L}}+)\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:{_AT} {_TIME})?{_ZONE}", "312"),
)


def _lookup(pairs: dict[str, object], key: Column) -> Column:
    """The value of a small constant table, null where the key is absent."""
    flat: list[Column] = []
    for k, v in pairs.items():
        flat += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*flat), key)


def known_zones(spark: SparkSession | None = None) -> list[str]:
    """IANA names both this Python and the JVM know; about 600, whatever the data."""
    names = available_timezones()
    if spark is not None and getattr(spark, "_jvm", None) is not None:
        names &= set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    return sorted(n for n in names if "/" in n or n in ("UTC", "GMT", "CET", "EET", "WET", "MET"))


def parse_timestamps(df: DataFrame, text: str, order: str) -> DataFrame:
    """Adds ``_local`` (TIMESTAMP_NTZ), ``_epoch`` (instant of a bare number),
    ``_offset`` (seconds named by the string), ``_word`` (zone abbreviation),
    ``_region`` (IANA name in lower case) and ``_free`` (it names no zone). ``order`` is a column holding DMY, MDY
    or YMD for all-numeric dates.
    """
    df = df.withColumn("_ts", _parsed(F.col(text), F.col(order)))
    return df.select("*", *[F.col(f"_ts.{n}").alias(f"_{n}") for n in ("local", "epoch", "offset", "word", "region", "free")]).drop("_ts")


def _parsed(text: Column, order: Column) -> Column:
    """A struct of what ``parse_timestamps`` adds."""
    t = F.lower(F.trim(F.regexp_replace(text, r"[\s\u00a0\u202f]+", " ")))
    t = F.regexp_replace(F.regexp_replace(t, r" uhr\b", ""), r" г\.?(?=[ ,]|$)", "")
    month_of = {name: n for n, names in MONTHS.items() for name in names.split()}
    # Each pattern rewrites what it matches into one delimited form, so every
    # string is scanned once a pattern and split once.
    canonical = F.translate(t, "|", " ")
    for family, pattern, (y, m, d) in _SHAPES:
        canonical = F.regexp_replace(canonical, pattern, f"{family}|${y}|${m}|${d}|$4|$5|$6|$7|$8|$9|$10")

    def fields(p: Column) -> Column:
        part = lambda i: F.nullif(F.get(p, F.lit(i)), F.lit(""))
        number = lambda i: part(i).try_cast("int")
        a, b, c = number(1), F.coalesce(number(2), _lookup(month_of, part(2))), number(3)
        mixed = F.get(p, F.lit(0)) == "numeric"
        by = F.upper(F.coalesce(order, F.lit("DMY")))
        month_leads = mixed & (by == "MDY")
        year_leads = ~mixed | ((by == "YMD") & (F.length(part(3)) < 4))
        year = F.when(year_leads, a).otherwise(c)
        hour = F.when(part(8).isNull(), number(4)).when(number(4).between(1, 12), number(4) % 12 + F.when(part(8) == "p", 12).otherwise(0))
        return F.struct(
            F.when(mixed & (year < 100), year + 2000).otherwise(year).alias("y"),
            F.when(month_leads, a).otherwise(b).alias("mo"),
            F.when(month_leads, b).when(year_leads, c).otherwise(a).alias("d"),
            F.when(part(4).isNull(), 0).otherwise(hour).alias("h"),
            F.coalesce(number(5), F.lit(0)).alias("mi"),
            F.coalesce(number(6), F.lit(0)).alias("s"),
            F.rpad(F.coalesce(part(7), F.lit("0")), 6, "0").substr(1, 6).try_cast("int").alias("us"),
            part(9).alias("zone"),
            part(10).alias("bracket"),
            F.when(F.size(p) == 1, F.get(p, F.lit(0))).alias("rest"),
        )

    def resolved(f: Column) -> Column:
        sane = f.y.between(1, 9999) & f.mo.between(1, 12) & f.d.between(1, 31) & (f.h < 24) & (f.mi < 60) & (f.s < 60)
        day = F.try_to_date(F.format_string("%04d-%02d-%02d", f.y, f.mo, f.d), "yyyy-MM-dd").cast("timestamp_ntz")
        local = F.timestamp_add("MICROSECOND", f.us, F.timestamp_add("SECOND", (f.h * 60 + f.mi) * 60 + f.s, day))
        zone = f.zone
        shape = r"([+-])(\d{1,2}):?(\d{2})?$"
        seconds = F.regexp_extract(zone, shape, 2).try_cast("int") * 3600 + F.coalesce(F.regexp_extract(zone, shape, 3).try_cast("int"), F.lit(0)) * 60
        offset = F.when(zone.rlike(shape) & ~zone.contains("/"), seconds * F.when(zone.contains("-"), -1).otherwise(1)).when(zone.isin("z", "utc"), 0)
        number = F.when(f.rest.rlike(r"^\d{1,15}$"), f.rest.try_cast("bigint"))
        zero = F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz")
        epoch = F.when(number >= 100_000_000_000, F.timestamp_add("MILLISECOND", number, zero)).when(number.isNotNull(), F.timestamp_add("SECOND", number, zero))
        region = F.coalesce(F.when(zone.contains("/"), zone), F.when(zone.isNull(), f.bracket))
        word = F.when(offset.isNull() & ~zone.contains("/"), zone)
        free = sane & zone.isNull() & f.bracket.isNull()
        return F.struct(F.when(sane, local).alias("local"), epoch.alias("epoch"), offset.alias("offset"), word.alias("word"), region.alias("region"), free.alias("free"))

    # Lambdas bind the split and the fields once; as plain columns the optimizer
    # would inline them at each of their uses.
    return F.get(F.transform(F.transform(F.array(F.split(canonical, r"\|", -1)), fields), resolved), F.lit(0))


#: Years whose abbreviations are looked up; dates before the first have those of the first,
#: dates after the last those of the last.
YEARS = (1900, 2100)


def read_instant(text: Column, order: str) -> Column:
    """The instant a text names, in UTC without zone: for one column and a constant order of
    all-numeric dates, zone-less times taken as UTC. Abbreviations other than GMT, UTC and
    Z, and names of zones that do not exist, give null."""
    found = _parsed(text, F.lit(order))
    zoned = F.when(found.offset.isNotNull(), F.timestamp_add("SECOND", -found.offset, found.local)).when(found.word == "gmt", found.local)
    regions = {name.lower(): name for name in known_zones()}
    region = F.when(found.region.isNotNull(), _lookup(regions, found.region))
    named = F.when(region.isNotNull(), F.convert_timezone(region, F.lit("UTC"), found.local))
    return F.coalesce(found.epoch, zoned, named, F.when(found.free, found.local))


def abbreviations(spark: SparkSession, zones: list[str], years: tuple[int, int] = YEARS) -> DataFrame:
    """(zone, word, year, seconds): the abbreviations each zone used in each year.

    Bounded by the IANA database and ``years``: at most a few hundred rows a zone.
    """
    rows = set()
    for name in zones:
        zone = ZoneInfo(name)
        for year in range(years[0], years[1] + 1):
            for month in range(1, 13):
                t = datetime(year, month, 15, tzinfo=timezone.utc).astimezone(zone)
                rows.add((name, (t.tzname() or "").lower(), t.year, int(t.utcoffset().total_seconds())))
    latest = {(z, w, y): s for z, w, y, s in sorted(rows)}
    # A frame travels as one Arrow batch and stays a local relation.
    frame = pd.DataFrame([(*k, s) for k, s in latest.items()] or [("", "", 0, 0)], columns=["_zone", "_word", "_year", "_seconds"])
    return spark.createDataFrame(frame, "_zone STRING, _word STRING, _year INT, _seconds INT")


def histories(years: tuple[int, int], zones: list[str] | None = None) -> dict[str, str]:
    """Every IANA zone with the zone that stands for its offset history over some years:
    zones whose offsets agree week by week are one history, named after the first of them.
    About 150 histories, whatever the data."""
    weeks = [datetime(years[0], 1, 1, tzinfo=timezone.utc) + timedelta(weeks=w) for w in range(53 * (years[1] - years[0] + 1))]
    first: dict[tuple, str] = {}
    out = {}
    for name in sorted(zones or known_zones(), key=lambda n: (n not in ("UTC", "GMT"), n)):
        zone = ZoneInfo(name)
        out[name] = first.setdefault(tuple(w.astimezone(zone).utcoffset() for w in weeks), name)
    return out


def estimate_zones(rows: DataFrame, source: str, local: str, ingested: str, candidates: DataFrame, window_minutes: int = 360) -> DataFrame:
    """The offset history of each source that its zone-less times violate least.

    ``candidates`` holds (source, _zone). A row violates a history when the
    instant it gives lies after the row was ingested; it supports one when it
    lies at most ``window_minutes`` before, the more the nearer it lies, since rows are
    ingested soon after they are published. Cost = 3 x violations - support, so a
    zone cannot win by placing everything far in the past; ties go to the
    smaller name. Rows are first counted by source, local hour and lag in
    quarter hours (lags no offset can bring into the window count as two bins), so
    candidates meet a bounded histogram and not the rows, and a source with a third of
    all rows is one small group.

    Returns (source, _zone, rows, violations, support) with one row a source.
    """
    width, widest = window_minutes // 15, 15 * 4
    lag = F.floor(F.expr(f"timestampdiff(SECOND, {local}, {ingested})") / 900)
    lag = F.greatest(F.lit(-widest - 1), F.least(F.lit(width + widest + 1), lag))
    seen = rows.where(F.col(local).isNotNull() & F.col(ingested).isNotNull())
    seen = seen.groupBy(F.col(source), F.expr(f"CAST(date_trunc('HOUR', {local}) AS TIMESTAMP_NTZ)").alias("_hour"), lag.alias("_lag")).agg(F.count("*").alias("_n"))
    seen = seen.join(candidates, source)
    shift = F.expr("timestampdiff(SECOND, convert_timezone(_zone, 'UTC', _hour), _hour)") / 900
    after = F.col("_lag") + shift
    costs = seen.groupBy(source, "_zone").agg(
        F.sum("_n").alias("rows"),
        F.sum(F.when(after < 0, F.col("_n")).otherwise(0)).alias("violations"),
        F.sum(F.when(after.between(0, width), F.col("_n") * (1 - after / (width + 1))).otherwise(0.0)).alias("support"),
    )
    best = Window.partitionBy(source).orderBy(F.col("violations") * 3 - F.col("support"), "_zone")
    return costs.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def to_utc(df: DataFrame, zone: str, words: DataFrame, regions: list[str]) -> DataFrame:
    """Adds ``utc`` as ``yyyy-MM-ddTHH:mm:ss.ffffffZ`` to parsed rows whose
    source follows the history in column ``zone``; null where there is no instant."""
    canonical = {name.lower(): name for name in regions}
    year = F.greatest(F.lit(YEARS[0]), F.least(F.lit(YEARS[1]), F.year("_local")))
    df = df.withColumn("_year", year).withColumn("_site", F.col(zone))
    df = df.join(F.broadcast(words.withColumnRenamed("_zone", "_site")), ["_site", "_word", "_year"], "left")
    named = F.when(F.col("_region").isNotNull(), _lookup(canonical, F.col("_region")))
    by_zone = F.when(F.col("_region").isNotNull(), named).when(F.col("_word").isNull(), F.col("_site"))
    seconds = F.coalesce(F.col("_offset"), F.col("_seconds"), F.when(F.col("_word") == "gmt", 0))
    df = df.withColumn("_by", by_zone).withColumn("_sec", seconds)
    instant = F.coalesce(
        F.col("_epoch"),
        F.when(F.col("_sec").isNotNull(), F.expr("timestampadd(SECOND, -_sec, _local)")),
        F.when(F.col("_by").isNotNull(), F.expr("convert_timezone(_by, 'UTC', _local)")),
    )
    text = instant.cast("string")
    utc = F.concat(text.substr(1, 10), F.lit("T"), text.substr(12, 8), F.lit("."), F.rpad(text.substr(21, 6), 6, "0"), F.lit("Z"))
    return df.withColumn("utc", utc).drop("_year", "_site", "_by", "_sec", "_seconds")


def site_settings(settings: DataFrame) -> DataFrame:
    """(spider_id, _zones, _order): the distinct zones a source's settings name, and
    its order of all-numeric dates (of repeated rows the last id holds)."""
    key = F.col("key")
    order = F.max_by(F.when(key == "DATE_ORDER", F.col("value")), F.when(key == "DATE_ORDER", F.col("id")))
    zones = F.array_sort(F.collect_set(F.when(key == "SITE_TIMEZONE", F.col("value"))))
    return settings.where(key.isin("SITE_TIMEZONE", "DATE_ORDER")).groupBy("spider_id").agg(zones.alias("_zones"), order.alias("_order"))


def normalise_published(rows: DataFrame, settings: DataFrame, text: str = "published_date", source: str = "spider_id", ingested: str | None = None, guess: bool = False) -> DataFrame:
    """``rows`` with ``utc``: the whole operator.

    A source's candidates are the zones its settings name. One needs no choice; of
    several the column ``ingested`` decides (without it the first by name). A
    source without any is in UTC, or with ``guess`` in the history of all there are
    that its ingestion times fit best.
    """
    spark = rows.sparkSession
    regions = known_zones(spark)
    sites = site_settings(settings).withColumnRenamed("spider_id", source)
    sites = sites.withColumn("_zones", F.filter("_zones", lambda z: z.isin(regions)))
    # At most as many rows as there are IANA zones.
    named = sorted({"UTC", *(r[0] for r in sites.select(F.explode("_zones")).distinct().collect())})
    if guess:
        named = sorted({*named, *histories(HISTORY_YEARS).values()})
    every = F.array(*[F.lit(z) for z in named])
    parsed = parse_timestamps(rows.join(sites, source, "left"), text, "_order")
    choice = F.get("_zones", F.lit(0))
    if ingested is not None:
        open_ = F.size("_zones") > 1
        wanted = F.when(open_, F.col("_zones"))
        if guess:
            open_ = open_ | (F.coalesce(F.size("_zones"), F.lit(0)) <= 0)
            wanted = F.coalesce(wanted, every)
        free = parsed.where(open_ & F.col("_free"))
        candidates = free.select(source, wanted.alias("_c")).distinct().select(source, F.explode("_c").alias("_zone"))
        found = estimate_zones(free, source, "_local", ingested, candidates)
        parsed = parsed.join(found.select(source, F.col("_zone").alias("_found")), source, "left")
        choice = F.coalesce("_found", choice)
    parsed = parsed.withColumn("_zone", F.coalesce(choice, F.lit("UTC")))
    out = to_utc(parsed, "_zone", abbreviations(spark, named), regions)
    return out.select(*rows.columns, "utc")


#: Years over which offset histories are told apart.
HISTORY_YEARS = (2015, 2030)


def estimated(rows: DataFrame, settings: DataFrame, text: str = "published_date", source: str = "spider_id", ingested: str = "scraped_at") -> tuple[DataFrame, DataFrame]:
    """(instants, sources) of the rows that name no zone, as if no source had a setting:
    instants are the rows with ``utc`` by the estimated history and ``agrees``, whether the
    configured zone gives the same; sources (source, configured, estimated, rows,
    agreeing, violations, support)."""
    spark = rows.sparkSession
    known = site_settings(settings).select(F.col("spider_id").alias(source), "_order", F.coalesce(F.get("_zones", F.lit(0)), F.lit("UTC")).alias("configured"))
    free = parse_timestamps(rows.join(known, source), text, "_order").where("_free AND _local IS NOT NULL")
    candidates = free.select(source).distinct().withColumn("_zone", F.explode(F.array(*[F.lit(z) for z in sorted(set(histories(HISTORY_YEARS).values()))])))
    found = stored(estimate_zones(free, source, "_local", ingested, candidates), "zones")
    chosen = free.join(found.select(source, F.col("_zone").alias("estimated")), source)
    at = lambda zone: F.convert_timezone(F.col(zone), F.lit("UTC"), F.col("_local"))
    regions = F.col("configured").isin(known_zones(spark))
    instants = chosen.withColumn("utc", F.date_format(at("estimated"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).withColumn("agrees", F.when(regions, at("estimated") == at("configured")).otherwise(False))
    counts = instants.groupBy(source, "configured").agg(F.count_if("agrees").alias("agreeing"))
    sources = counts.join(found, source).select(source, "configured", F.col("_zone").alias("estimated"), "rows", "agreeing", "violations", "support")
    return instants.select(*rows.columns, "utc", "agrees"), sources


def published_rows(items: DataFrame, export: DataFrame, export_name: str) -> DataFrame:
    """(tbl, id, spider_id, published_date, scraped_at) of the items and of the
    export, whose rows take the spider of the item with their id."""
    columns = ("id", "published_date", "scraped_at")
    own = items.select(F.lit("scraped_items").alias("tbl"), "spider_id", *columns)
    theirs = export.select(F.lit(export_name).alias("tbl"), *columns).join(items.select("id", "spider_id"), "id", "left")
    return own.unionByName(theirs)
