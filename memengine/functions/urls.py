"""URL, host and address expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .core import any_of, contains_any, let, strip, string_array


def _form_decode(part: Column) -> Column:
    # try_url_decode gives NULL for a malformed escape: keep the text as it is.
    return F.coalesce(F.try_url_decode(part), F.translate(part, "+", " "))


def _form_encode(part: Column) -> Column:
    # Java keeps '*' and escapes '~'; form encoding wants it the other way round.
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column, ignored: list[str] | None = None) -> Column:
    """Drop tracking parameters and the fragment; keep order and blank values."""
    ignored_names = string_array(ignored or K.TRACKING_PARAMS)
    no_fragment = F.regexp_replace(url, r"(?s)#.*$", "")
    address = F.regexp_extract(no_fragment, r"(?s)^([^?]*)", 1)
    scheme = F.regexp_extract(address, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    address = F.concat(F.lower(scheme), F.substring(address, F.length(scheme) + 1, F.length(address)))
    query = F.regexp_extract(no_fragment, r"(?s)\?(.*)$", 1)

    def name(pair: Column) -> Column:
        return _form_decode(F.regexp_extract(pair, r"(?s)^([^=]*)", 1))

    def value(pair: Column) -> Column:
        return _form_decode(F.regexp_extract(pair, r"(?s)=(.*)$", 1))

    kept = F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~F.array_contains(ignored_names, F.lower(name(p))),
    )
    encoded = F.array_join(
        F.transform(kept, lambda p: F.concat(_form_encode(name(p)), F.lit("="), _form_encode(value(p)))), "&"
    )
    with_query = let(
        encoded, lambda q: F.when(q == "", address).otherwise(F.concat(address, F.lit("?"), q))
    )
    return F.when(query == "", address).otherwise(with_query)


def domain_hint(url_or_domain: Column) -> Column:
    """Host part of a URL (user info and port kept) or the cleaned host itself."""
    host = F.lower(F.regexp_extract(url_or_domain, r"://([^/?#]*)", 1))
    return F.coalesce(
        F.when(url_or_domain.contains("://"), host).otherwise(F.lower(strip(url_or_domain))), F.lit("")
    )


def sender_domain(sender: Column) -> Column:
    """Text after the first ``@`` of the bracketed (or bare) address."""
    bracketed = F.regexp_extract(sender, r"<([^>]+)>", 1)
    address = F.when(bracketed != "", bracketed).otherwise(sender)
    after_at = F.substring(address, F.instr(address, "@") + 1, F.length(address))
    return F.coalesce(F.when(address.contains("@"), F.lower(strip(after_at))), F.lit(""))


def is_app_page(domain: Column, apps: list[str] | None = None) -> Column:
    host = F.lower(strip(F.coalesce(domain, F.lit(""))))
    apps = apps or K.APP_DOMAINS
    return host.isin(apps) | any_of(host.endswith("." + a) for a in apps)


def is_excluded_path(url: Column, paths: list[str] | None = None) -> Column:
    return contains_any(F.lower(F.coalesce(url, F.lit(""))), paths or K.EXCLUDED_PATHS)


def is_skipped_visit(url: Column, private_mode: Column) -> Column:
    """Visits the capture side never records."""
    empty = F.coalesce(url, F.lit("")) == ""
    prefixed = any_of(url.startswith(p) for p in K.CAPTURE_SKIPPED_PREFIXES)
    return empty | F.coalesce(private_mode, F.lit(False)) | prefixed | contains_any(url, K.EXCLUDED_PATHS)


def is_video_url(url: Column) -> Column:
    return F.coalesce(contains_any(url, K.VIDEO_URL_PATTERNS), F.lit(False))


def video_id(url: Column) -> Column:
    """Eleven characters after ``watch?v=``, else the first path part after ``/shorts/``."""
    size = K.VIDEO_ID_LENGTH

    def exact(candidate: Column) -> Column:
        head = F.substring(candidate, 1, size)
        return F.when(F.length(head) == size, head)

    # A second marker ends the first candidate, hence the lazy stop.
    watched = F.regexp_extract(url, r"(?s)watch\?v=(.*?)(?:watch\?v=|$)", 1)
    short = F.regexp_extract(url, r"(?s)/shorts/([^?/]*)", 1)
    return F.coalesce(exact(watched), exact(short))


def is_short(url: Column, duration: Column) -> Column:
    return F.coalesce(url.contains("/shorts/"), F.lit(False)) | F.coalesce(
        duration < K.SHORT_VIDEO_SECONDS, F.lit(False)
    )


def key_hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)
