"""URL parts, dependency identities and request classes as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.shape import either
from tidemark.functions.text import bind, path_family

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
HOST = (
    r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?"
    r"(\[[^\]/?#]*\]|[^:/?#@\[]*?[^:/?#@\[.])\.*(?::[^/?#]*)?(?:[/?#]|$)"
)
PORT = r":(\d+)$"

# --- fixed values: dependency categories, first match wins --------------------------------
CATEGORIES = (
    ("GOOGLE_AD_SERVING", ("googlesyndication", "doubleclick", "gampad", "securepubads")),
    ("HEADER_BIDDING_SSP", ("prebid", "openrtb", "bidder", "ssp")),
    ("CMP_PRIVACY", ("consent", "cmp", "privacy", "quantcast", "didomi")),
    ("ANALYTICS", ("analytics", "google-analytics", "gtag", "segment")),
    ("VIDEO_PLAYER", ("player", "video", "vast", "ima3")),
    ("CDN", ("cdn", "static", "assets")),
)
# --- fixed values: request classes -----------------------------------------------------------
VAST_PATH = r"(?:^|[/_.-])(vast|vmap|video-?ad|ad-?tag)(?:[/_.-]|$)"
MEDIA_EXTENSIONS = (".m3u8", ".m4s", ".mp4", ".mpd", ".ogg", ".ogv", ".ts", ".webm")
AD_SERVER_HOSTS = ("doubleclick", "googlesyndication", "securepubads")
AD_SERVER_PATH = "/gampad/ads"
BID_SERVER_PATHS = ("/openrtb2/auction", "/openrtb2/amp")


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dots; null when there is none."""
    # One extraction, null without a match: every reference to a host costs a single scan.
    return F.lower(F.try_element_at(F.regexp_extract_all(url, F.lit(HOST), F.lit(1)), F.lit(1)))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def _any_in(value: Column, needles: tuple[str, ...]) -> Column:
    return value.rlike("|".join(re.escape(n) for n in needles))


def dependency_category(host_column: Column, path_column: Column) -> Column:
    return bind(
        F.lower(F.concat(host_column, path_column)),
        lambda value: either(*[(_any_in(value, needles), name) for name, needles in CATEGORIES], otherwise="UNKNOWN"),
    )


def resource_type(kind: Column) -> Column:
    name = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(name == "", "other").otherwise(name)


def dependency_key(url: Column, kind: Column) -> Column:
    """host|path family|type; null without a host."""
    return F.concat(host(url), F.lit("|"), path_family(path(url)), F.lit("|"), resource_type(kind))


def is_vast(path_column: Column) -> Column:
    return F.lower(path_column).rlike(VAST_PATH)


def is_media(path_column: Column, kind: Column) -> Column:
    ending = "(" + "|".join(re.escape(e) for e in MEDIA_EXTENSIONS) + ")$"
    return F.coalesce(kind == "media", F.lit(False)) | F.lower(path_column).rlike(ending)


def is_ad_server(host_column: Column, path_column: Column) -> Column:
    return F.coalesce(_any_in(host_column, AD_SERVER_HOSTS), F.lit(False)) | F.contains(
        F.lower(path_column), F.lit(AD_SERVER_PATH)
    )


def is_bid_server(path_column: Column) -> Column:
    return _any_in(F.lower(path_column), BID_SERVER_PATHS)


def is_third_party(host_column: Column, site_domain: Column) -> Column:
    return (host_column != site_domain) & ~F.endswith(host_column, F.concat(F.lit("."), site_domain))


def canonical_url(href: Column, base: Column) -> Column:
    """Absolute http(s) URL: lower scheme and host, no fragment, at least '/' as path.

    Relative references resolve against the base; dot segments are kept as written.
    """
    ref = F.trim(href)
    scheme = F.lower(F.regexp_extract(base, SCHEME, 1))
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(base, AUTHORITY, 1))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    absolute = either(
        (F.coalesce(ref, F.lit("")) == "", None),
        (ref.rlike(SCHEME), ref),
        (F.startswith(ref, F.lit("//")), F.concat(scheme, F.lit(":"), ref)),
        (F.startswith(ref, F.lit("/")), F.concat(origin, ref)),
        (F.startswith(ref, F.lit("?")), F.concat(origin, path(base), ref)),
        (F.startswith(ref, F.lit("#")), base),
        otherwise=F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), ref),
    )
    name = host(absolute)
    port = F.regexp_extract(F.regexp_extract(absolute, AUTHORITY, 1), PORT, 1)
    own_path, query = path(absolute), F.regexp_extract(absolute, QUERY, 1)
    built = F.concat(
        F.lower(F.regexp_extract(absolute, SCHEME, 1)), F.lit("://"), name,
        F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""),
        F.when(own_path == "", "/").otherwise(own_path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    usable = F.lower(F.regexp_extract(absolute, SCHEME, 1)).isin("http", "https") & name.isNotNull()
    return F.when(usable, built)


# --- fixed values: percent normalization -------------------------------------------------------
OCTET_TOKEN = r"(?s)(%[0-9A-Fa-f]{2}|.)"
UNRESERVED = r"^[A-Za-z0-9._~-]$"


def norm_octets(value: Column) -> Column:
    """Decode unreserved escapes, upper-case the others, escape everything outside visible ASCII."""

    def one(token: Column) -> Column:
        octet = F.conv(F.substring(token, 2, 2), 16, 10).cast("int")
        decoded = F.char(octet)
        return either(
            ((F.length(token) == 3) & (octet < 128) & decoded.rlike(UNRESERVED), decoded),
            (F.length(token) == 3, F.upper(token)),
            (token == "%", F.lit("%25")),
            (token.rlike(r"^[\x21-\x7e]$"), token),
            otherwise=F.regexp_replace(F.hex(F.encode(token, "UTF-8")), "(..)", "%$1"),
        )

    # Visible ASCII without escapes stays as it is; only the rest is taken apart.
    taken = F.array_join(F.transform(F.regexp_extract_all(value, F.lit(OCTET_TOKEN), F.lit(1)), one), "")
    return F.when(value.rlike(r"\A[\x21-\x24\x26-\x7e]*\z"), value).otherwise(taken)


def octets_valid(value: Column) -> Column:
    return ~value.rlike(r"%(?![0-9A-Fa-f]{2})")


def octet_length_of_rule(pattern: Column) -> Column:
    """Rule specificity: octets of the pattern without wildcards and end anchor."""
    core = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"\*", "")
    return F.octet_length(F.regexp_replace(core, "(?s)%..", "x")).cast("int")


DOMAIN = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+$"


@F.pandas_udf(StringType())
def _idna(names: pd.Series) -> pd.Series:
    def encode(name):
        try:
            return None if name is None else name.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return names.map(encode)


def norm_domain(value: Column, international: bool = False) -> Column:
    """Trimmed lower-case domain with at least two valid labels, else null.

    With ``international`` the names outside ASCII (and only those) pass through one Arrow
    helper that applies the IDNA encoding; without it they are rejected.
    """
    name = F.lower(F.regexp_replace(F.trim(value), r"\.+$", ""))
    if international:
        foreign = name.rlike(r"[^\x00-\x7f]")
        name = F.coalesce(F.when(~foreign, name), _idna(F.when(foreign, name)))
    return bind(name, lambda n: F.when((F.length(n) <= 253) & n.rlike(DOMAIN), n))
