"""Urls as columns: parts, names, and targets seen from a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)"
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 2), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 3), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments (RFC 3986, 5.2.4)."""
    step = lambda seen, x: F.when(x == "..", F.regexp_replace(seen, "/[^/]*$", "")).when(x == ".", seen).otherwise(F.concat(seen, F.lit("/"), x))
    walked = F.aggregate(F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/"))), F.lit(""), step)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(walked, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)


def name_of(url: Column) -> Column:
    """What a url names: scheme and host in lower case, no dot segments, ``/`` for an empty
    path, no fragment. Null without ``://``."""
    scheme = F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER)
    path = F.when(path_of(url) == "", "/").otherwise(without_dots(path_of(url)))
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), path, F.regexp_extract(url, URL, 4)))


def resolved(target: Column, url: Column) -> Column:
    """A link target as an absolute url, seen from ``url``."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    scheme, host = F.regexp_extract(url, URL, 1), host_of(url)
    base = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(target.rlike(ABSOLUTE), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .when(target.startswith("?"), F.concat(base, path_of(url), target))
        .when(target.startswith("#") | (target == ""), url)
        .otherwise(F.concat(base, F.regexp_replace(F.concat(path_of(url), F.when(path_of(url) == "", "/").otherwise("")), r"[^/]*$", ""), target))
    )
