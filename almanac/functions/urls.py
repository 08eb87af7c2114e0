"""URL identity, comparison and shape checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ports that an address need not name, and names of the own machine.
DEFAULT_PORT = {"http": "80", "https": "443"}
LOCAL_NAMES = ("localhost", "localhost.localdomain")
#: Scheme, who asks, host, port, path, query, fragment.
ADDRESS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?(\[[^\]]*\]|[^/?#:@]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def address_part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, ADDRESS, n)


def plain_path(path: Column) -> Column:
    """A path without the segments . and .. and without closing slashes."""
    dots = lambda x: F.regexp_replace(x, "(?i)%2e", ".")
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.slice(F.split(path, "/"), 2, 1 << 20), none, lambda kept, x: F.when(dots(x) == "..", up(kept)).when(dots(x) == ".", kept).otherwise(F.array_append(kept, x)))
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/")), "/+$", "")


def url_identity(url: Column) -> Column:
    """What one page is known by: host, path and query in lower case.

    Scheme, who asks, a port that the scheme has anyway, fragment and closing slashes go, and . and ..
    are followed; the slug after the first segment of digits loses its punctuation.  A text that is no
    URL stands for itself in lower case; a blank one is null.
    """
    text = F.trim(url)
    scheme, host, port, query = (address_part(text, n) for n in (1, 3, 4, 6))
    usual = F.lit(False)
    for name, number in DEFAULT_PORT.items():
        usual = usual | ((F.lower(scheme) == name) & (port == number))
    port = F.when((port == "") | usual, "").otherwise(F.concat(F.lit(":"), port))
    path = plain_path(address_part(text, 5))
    ahead, slug, rest = (F.regexp_extract(path, r"^((?:/(?![0-9]+/)[^/]*)*/[0-9]+/)([^/]*)(.*)$", k) for k in (1, 2, 3))
    path = F.when(ahead != "", F.concat(ahead, F.regexp_replace(slug, "[^A-Za-z0-9]", ""), rest)).otherwise(path)
    return F.nullif(F.lower(F.when(host != "", F.concat(host, port, path, F.when(query == "?", "").otherwise(query))).otherwise(text)), F.lit(""))


def loose_url(url: Column) -> Column:
    """Host name and path in lower case, without one closing slash."""
    host = address_part(url, 3)
    return F.lower(F.when(host != "", F.concat(host, F.regexp_replace(address_part(url, 5), "/$", ""))).otherwise(url))


def same_page(url: Column, claim: Column) -> Column:
    return loose_url(url) == loose_url(claim)


def has_shape(url: Column, host: str, path: str) -> Column:
    """https, exactly this host, a path that matches in full, and no port, credentials, query or fragment."""
    return F.coalesce(url.rlike(rf"^https://\Q{host}\E{path}$"), F.lit(False))


def private_host(host: Column) -> Column:
    """Whether a host is of the own machine or of a private, link-local, multicast or reserved network."""
    bare = F.regexp_replace(F.lower(host), r"[\[\]]", "")
    parts = F.when(bare.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.transform(F.split(bare, r"\."), lambda x: x.cast("int")))
    a, b = parts[0], parts[1]
    inner = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | (a >= 224)
    local = bare.isin(*LOCAL_NAMES) | (bare == "::1") | bare.startswith("fe80:") | bare.startswith("fc") | bare.startswith("fd")
    return F.coalesce(inner, F.lit(False)) | local


def allowed_host(url: Column, hosts: list[str]) -> Column:
    """https on exactly a listed host, with or without www., asked for by nobody, on the usual port, and never private."""
    scheme, asks, host, port = (address_part(F.trim(url), n) for n in (1, 2, 3, 4))
    bare = F.regexp_replace(F.lower(host), r"^www\.", "")
    sound = (F.lower(scheme) == "https") & (asks == "") & port.isin("", DEFAULT_PORT["https"])
    return F.coalesce(sound & bare.isin(*hosts) & ~private_host(bare), F.lit(False))
