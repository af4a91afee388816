"""URL parts, predicates and names, as expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings that are no pages.
IGNORED = "7z 7zip bz2 rar tar gz tgz xz zip mng pct bmp gif jpg jpeg png pst psp tif tiff ai drw dxf eps ps svg cdr ico webp mp3 wma ogg wav ra aac mid au aiff 3gp asf asx avi mov mp4 mpg qt rm swf wmv m4a m4v flv webm xls xlsx ppt pptx pps doc docx odt ods odg odp css pdf exe bin rss dmg iso apk jar sh rb js hta bat cpl msi msp py"


def netloc(url: Column) -> Column:
    """Host and port in their own case; null without an authority."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def hostname(url: Column) -> Column:
    """The host in lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def queue_name(url: Column) -> Column:
    """A spider's name as the queue makes it: leading w and dot characters go."""
    return F.translate(F.regexp_replace(netloc(url), r"^[w.]+", ""), ".-", "__")


def expected_name(url: Column) -> Column:
    """A spider's name as imports expect it: ``www.`` goes wherever it stands."""
    return F.translate(F.replace(netloc(url), F.lit("www."), F.lit("")), ".", "_")


def is_pdf(url: Column, content_type: Column | None = None) -> Column:
    """A path ending in .pdf, or a PDF content type."""
    found = F.lower(F.regexp_replace(url, r"[?#].*", "")).endswith(".pdf")
    return found | F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False)) if content_type is not None else found


def is_not_html(url: Column) -> Column:
    low = F.lower(url)
    return low.rlike(r"\.(xml|json|txt)([?#]|$)") | F.lower(path(url)).contains("/sitemap")


def has_ignored_ending(url: Column, keep_pdf: bool = False) -> Column:
    ending = F.regexp_extract(F.lower(path(url)), r"\.([a-z0-9]+)$", 1)
    endings = [e for e in IGNORED.split() if not (keep_pdf and e == "pdf")]
    return ending.isin(*endings)


def pdf_title(url: Column) -> Column:
    """The decoded file name of a URL, or the URL; a plus stays a plus."""
    name = F.element_at(F.split(path(url), "/"), -1)
    return F.coalesce(F.nullif(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), F.lit("")), url)


def within(host: Column, domains: Column) -> Column:
    """Whether a host is one of the domains or below one. The host travels in the array:
    Spark numbers a lambda's variables anew and takes a column with the same number for
    one of them, so a filter whose lambda refers to a column can end up below the join
    that brings this column."""
    pairs = F.arrays_zip(domains.alias("domain"), F.array_repeat(host, F.size(domains)).alias("host"))
    return F.exists(pairs, lambda x: (x["host"] == F.lower(x["domain"])) | x["host"].endswith(F.concat(F.lit("."), F.lower(x["domain"]))))


def archived(url: Column) -> Column:
    """(day, site) of an archived copy's URL, nulls for others."""
    pattern = r"/web/(\d{8})\d*[a-z_]*/(?:https?:?/+)?(?:www\.)?([^/?#]+)"
    part = lambda n: F.nullif(F.regexp_extract(url, pattern, n), F.lit(""))
    return F.struct(part(1).alias("day"), part(2).alias("site"))


def fetchable(url: Column) -> Column:
    """http(s), a host that is no private, local or reserved address, at most 2048
    characters. Addresses are read in dotted form, as one number, in octal and hex, and as
    IPv6, mapped ones too. Names are not resolved."""
    host = hostname(url)
    number = lambda x: F.when(x.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(x, 3, 16), 16, 10)).when(x.rlike("^0[0-7]{1,11}$"), F.conv(x, 8, 10)).when(x.rlike(r"^\d{1,10}$"), x).try_cast("bigint")
    parts = F.transform(F.split(host, r"\."), number)
    n = F.size(parts)
    whole = F.when(n == 1, F.get(parts, F.lit(0)))
    for k in (2, 3, 4):  # the last part fills what the others leave
        own = F.get(parts, F.lit(k - 1))
        for place in range(k - 1):
            own = own + F.get(parts, F.lit(place)) * (256 ** (3 - place))
        whole = F.when(n == k, own).otherwise(whole)
    whole = F.when(n <= 4, whole)
    dotted = F.when(whole.between(0, 4294967295), F.concat_ws(".", *[(F.floor(whole / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)]))
    mapped = F.regexp_extract(host, r"^\[(?:::ffff:)(\d+\.\d+\.\d+\.\d+)\]$", 1)
    address = F.coalesce(F.nullif(mapped, F.lit("")), dotted)
    private = address.rlike(r"^(0|10|127|22[4-9]|23\d|24\d|25[0-5])\.|^(169\.254|192\.168|172\.(1[6-9]|2\d|3[01])|192\.0\.[02]|198\.1[89]|198\.51\.100|203\.0\.113)\.")
    local = host.rlike(r"^(localhost|.*\.localhost|\[(::1?|f[cd].*|fe[89ab].*)\])$") | F.coalesce(private, F.lit(False))
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#]+") & ~local & (F.length(url) <= 2048), F.lit(False))


def absolute(base: Column, link: Column) -> Column:
    """A link against its page. The usual forms are expressions; dots and bare
    relative links go through one Arrow function."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    simple = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+(/|$)") & ~link.contains("/."), link)
        .when(link.startswith("//") & ~link.contains("/."), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/") & ~link.contains("/."), F.concat(scheme, F.lit("://"), netloc(base), link))
    )

    @F.pandas_udf("string")
    def joined(base: pd.Series, link: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(base, link)], dtype=object)

    return F.coalesce(simple, F.when(simple.isNull(), joined(base, link)))
