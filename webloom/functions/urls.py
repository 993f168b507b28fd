"""URL expressions. All of them stay inside the JVM: no Python worker is started.

``split_url`` returns the parts as columns; everything else is built on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track the visitor.
TRACKING_PARAMS = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "fbclid",
    "gclid",
    "msclkid",
    "ref",
    "source",
)

# Query keys whose value is masked.
SENSITIVE_PARAMS = (
    "password",
    "passwd",
    "token",
    "auth_token",
    "api_key",
    "apikey",
    "key",
    "authorization",
    "secret",
    "client_secret",
    "private_key",
    "signature",
    "sig",
    "csrf_token",
    "sessionid",
    "sid",
    "access_token",
    "refresh_token",
    "jwt",
    "bearer",
)

# Path extensions that are downloads rather than pages.
DOWNLOAD_EXTENSIONS = (
    # archives
    "tar", "gz", "tgz", "bz2", "xz", "z", "7z", "zip", "rar", "jar", "iso", "dmg",
    "exe", "pkg", "deb", "rpm", "apk", "msi", "msix", "sigstore",
    # data
    "csv", "tsv", "json", "xml", "yaml", "yml", "sql", "sqlite", "db", "dat", "bin", "log",
    # ebooks
    "epub", "mobi", "azw", "azw3",
    # documents
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "ps",
    "pages", "key", "numbers",
    # images
    "mng", "pct", "bmp", "gif", "jpg", "jpeg", "png", "pst", "psp", "tif", "tiff", "ai",
    "drw", "dxf", "eps", "svg", "cdr", "ico", "webp",
    # audio
    "mp3", "wma", "ogg", "wav", "ra", "aac", "mid", "au", "aiff", "flac",
    # video
    "3gp", "asf", "asx", "avi", "mov", "mp4", "mpg", "qt", "rm", "swf", "wmv", "webm", "mkv",
    # web files that are not HTML
    "css", "js", "rss", "atom",
)

# A short suffix list; callers with the full public list pass it instead.
PUBLIC_SUFFIXES = (
    "com", "org", "net", "edu", "gov", "int", "mil", "info", "biz", "io", "dev", "app",
    "de", "fr", "es", "it", "nl", "pl", "ru", "cn", "jp", "uk", "br", "in", "au", "us",
    "co.uk", "org.uk", "ac.uk", "gov.uk", "co.jp", "or.jp", "ne.jp", "com.au", "net.au",
    "org.au", "com.br", "com.cn", "org.cn", "co.in", "github.io",
)

# What may stand in a path or query: RFC 3986's unreserved characters, delimiters and percent signs; other scripts are let through.
_UNRESERVED, _DELIMITERS, _OTHER_SCRIPTS = r"A-Za-z0-9\-._~", r":/?#\[\]@!$&'()*+,;=", r"\x{80}-\x{10FFFF}"
# A space is judged elsewhere.
UNSAFE = f"[^ %{_UNRESERVED}{_DELIMITERS}{_OTHER_SCRIPTS}]"

# Most URLs are usable as they stand, many are canonical already: one pattern settles those.
_PLAIN = f"[%{_UNRESERVED}{_DELIMITERS.replace('?#', '')}{_OTHER_SCRIPTS}]"
_USABLE = rf"^[Hh][Tt][Tt][Pp][Ss]?://[^/?#\x00-\x20]+(?:/{_PLAIN}*)?(?:\?(?:{_PLAIN}|\?)*)?(?:#.*)?$"
_CANONICAL = r"^https?://[a-z0-9.\-]+/(?:[^?#;\x00-\x20]*[^?#;/\x00-\x20])?$"

_LEADING_JUNK = "".join(chr(c) for c in range(0x21))


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_SCHEME = r"(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
_AUTH = rf"^{_SCHEME}//(?:[^/?#]*@)?+"


class UrlParts:
    """Parts of a URL as columns, made when asked for; absent parts are '' (port: NULL).

    Every part is one regular expression over the URL itself, so expressions
    built on the parts stay small.
    """

    def __init__(self, url: Column):
        self._u = F.translate(F.ltrim(url, F.lit(_LEADING_JUNK)), "\t\r\n", "")

    def _part(self, pattern: str) -> Column:
        return F.regexp_extract(self._u, pattern, 1)

    @cached_property
    def scheme(self) -> Column:
        return F.lower(self._part(r"^([A-Za-z][A-Za-z0-9+.\-]*):"))

    @cached_property
    def netloc(self) -> Column:
        return self._part(rf"^{_SCHEME}//([^/?#]*)")

    @cached_property
    def path(self) -> Column:
        """Path without the ;params of its last segment."""
        path = self._part(rf"^{_SCHEME}(?://[^/?#]*)?([^?#]*)")
        return F.when(F.contains(path, F.lit(";")), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)

    @cached_property
    def query(self) -> Column:
        return self._part(r"^[^?#]*\?([^#]*)")

    @cached_property
    def userinfo(self) -> Column:
        return self._part(rf"^{_SCHEME}//([^/?#]*)@")

    @cached_property
    def host(self) -> Column:
        return F.lower(F.translate(self._part(_AUTH + r"(\[[^\]/?#]*\]|[^:/?#]*)"), "[]", ""))

    @cached_property
    def port(self) -> Column:
        return F.nullif(self._part(_AUTH + r"(?:\[[^\]/?#]*\]|[^:/?#]*):([^/?#]*)"), F.lit(""))


def split_url(url: Column | str) -> UrlParts:
    return UrlParts(_as_col(url))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def percent_decode(c: Column, plus_is_space: bool = False) -> Column:
    """Percent-decoding that leaves malformed sequences as they are."""
    guarded = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    if not plus_is_space:
        guarded = F.replace(guarded, F.lit("+"), F.lit("%2B"))
    needs = F.contains(c, F.lit("%")) | F.contains(c, F.lit("+"))
    return F.when(needs, F.try_url_decode(guarded)).otherwise(c)


def form_encode(c: Column) -> Column:
    """Encoding of one query key or value: letters, digits and ``_.-~`` stay, blank gives +."""
    encoded = F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(c.rlike(r"[^A-Za-z0-9_.\-]"), encoded).otherwise(c)


def canonical_query(query: Column, tracking: Iterable[str] = TRACKING_PARAMS) -> Column:
    """Drop blank and tracking pairs; repeated keys move to the place of their first use."""
    tracking = tuple(tracking)

    def grouped(kept: Column) -> Column:
        keys = F.array_distinct(F.transform(kept, lambda p: p["k"]))
        pairs = F.flatten(F.transform(keys, lambda k: F.filter(kept, lambda p: p["k"] == k)))
        return F.array_join(
            F.transform(pairs, lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"]))), "&"
        )

    pairs = F.transform(
        F.filter(F.split(query, "&", -1), lambda p: p.rlike("(?s)^[^=]*=.")),
        lambda p: F.struct(
            percent_decode(F.substring_index(p, "=", 1), True).alias("k"),
            percent_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)), True).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*tracking))
    return F.when(F.contains(query, F.lit("=")), let(kept, grouped)).otherwise(F.lit(""))


def ascii_host(host: Column) -> Column:
    """IDNA form of a host; hosts that cannot be converted stay as they are."""
    idna = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host)
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.coalesce(F.lower(idna), host)).otherwise(host)


def canonical_url(url: Column | str, tracking: Iterable[str] = TRACKING_PARAMS) -> Column:
    """Canonical form. NULL when the port is not a number from 0 to 65535."""
    p = split_url(url)
    host = ascii_host(p.host)
    host = F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    user = F.substring_index(p.userinfo, ":", 1)
    password = F.substring(p.userinfo, F.length(user) + 2, F.length(p.userinfo))
    userinfo = (
        F.when(user == "", F.lit(""))
        .when(password == "", F.concat(F.lower(user), F.lit("@")))
        .otherwise(F.concat(F.lower(user), F.lit(":"), F.lower(password), F.lit("@")))
    )
    number = F.when(p.port.rlike(r"^[0-9]{1,9}$"), p.port.cast("int"))
    default = ((p.scheme == "http") & (number == 80)) | ((p.scheme == "https") & (number == 443))
    port = F.when(p.port.isNull() | default, F.lit("")).when(
        number.between(0, 65535), F.concat(F.lit(":"), number.cast("string"))
    )
    path = F.rtrim(p.path, F.lit("/"))
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.when(p.query == "", F.lit("")).otherwise(canonical_query(p.query, tracking))
    same = _as_col(url).rlike(_CANONICAL)
    head = F.when(p.scheme == "", F.lit("")).otherwise(F.concat(p.scheme, F.lit(":")))
    body = F.concat(F.lit("//"), userinfo, host, port, path)
    made = F.concat(head, body, let(query, lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))))
    return F.when(same, _as_col(url)).otherwise(made)


def invalid_reason(url: Column | str) -> Column:
    """Why a URL is not a usable http URL; NULL when it is."""
    p = split_url(url)
    return (
        F.when(_as_col(url).rlike(_USABLE), F.lit(None).cast("string"))
        .when(~p.scheme.isin("http", "https") | p.scheme.isNull(), "bad_scheme")
        .when(p.netloc == "", "no_host")
        .when(p.path.rlike(UNSAFE), "illegal_path")
        .when(p.query.rlike(UNSAFE), "illegal_query")
        .when(F.contains(p.path, F.lit(" ")) | F.contains(p.query, F.lit(" ")), "space")
    )


def has_bad_port(url: Column | str) -> Column:
    port = split_url(url).port
    return port.isNotNull() & ~F.coalesce(port.rlike(r"^[0-9]{1,5}$") & (port.try_cast("int") <= 65535), F.lit(False))


def path_extension(url: Column | str) -> Column:
    """Lower-case text after the last dot of the path; NULL when there is no dot."""
    path = split_url(url).path
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1)))


def is_download(url: Column | str) -> Column:
    return F.coalesce(path_extension(url).isin(*DOWNLOAD_EXTENSIONS), F.lit(False))


def origin_of(url: Column | str) -> Column:
    p = split_url(url)
    return F.concat(p.scheme, F.lit("://"), p.netloc)


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` gives [a.b.c, b.c, c]."""

    def joined(labels: Column) -> Column:
        count = F.size(labels)
        return F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count), "."))

    return let(F.split(F.rtrim(host, F.lit(".")), r"\."), joined)


def suffix_labels(host: Column, suffixes: Iterable[str] = PUBLIC_SUFFIXES) -> Column:
    """Number of labels of the public suffix of a host, by a short list of rules.

    ``*.ck`` makes every name below ``ck`` a suffix, ``!www.ck`` is an exception
    to that; else the longest rule holds, and without a rule the last label.
    """
    rules = tuple(suffixes)
    plain = [r for r in rules if r[:1] not in "*!"]
    wild = [r[2:] for r in rules if r.startswith("*.")]
    spared = [r[1:] for r in rules if r.startswith("!")]

    def longest(parts: Column, names: list[str], extra: int) -> Column:
        # Suffixes come longest first; a wildcard needs one label more than its own.
        fits = F.filter(parts, lambda s, i: s.isin(*names) & (i > 0 if extra > 0 else F.lit(True)))
        return F.size(F.split(F.get(fits, F.lit(0)), r"\.")) + extra

    def labels(parts: Column) -> Column:
        found = F.greatest(longest(parts, plain, 0) if plain else F.lit(1), longest(parts, wild, 1) if wild else F.lit(1), F.lit(1))
        return F.when(F.coalesce(longest(parts, spared, -1), F.lit(0)) > 0, longest(parts, spared, -1)).otherwise(found) if spared else found

    return let(host_suffixes(host), labels)


def registrable_of(host: Column, suffix: Column) -> Column:
    """One label more than a suffix of so many labels; the host itself when it has no more."""
    return F.when(F.size(F.split(host, r"\.")) <= suffix, host).otherwise(F.call_function("substring_index", host, F.lit("."), -(suffix + 1)))


def without_www(host: Column, suffix: Column) -> Column:
    """Drop a leading ``www.`` unless the rest is itself a public suffix."""
    rest = host.substr(F.lit(5), F.length(host))
    own = (F.size(F.split(host, r"\.")) - 1 <= suffix) | ~F.contains(rest, F.lit("."))
    return F.when(F.startswith(host, F.lit("www.")) & ~own, rest).otherwise(host)


def registrable_domain(host: Column, suffixes: Iterable[str] = PUBLIC_SUFFIXES) -> Column:
    return registrable_of(host, suffix_labels(host, suffixes))


def strip_www(host: Column, suffixes: Iterable[str] = PUBLIC_SUFFIXES) -> Column:
    """``without_www``, where only hosts that begin with ``www.`` are looked up."""
    return F.when(F.startswith(host, F.lit("www.")), without_www(host, suffix_labels(host, suffixes))).otherwise(host)


def domain_of(url: Column | str, suffixes: Iterable[str] = PUBLIC_SUFFIXES) -> Column:
    return strip_www(split_url(url).host, suffixes)


def _folded_path(base_path: Column, path: Column) -> Column:
    """Path merged with the directory of the base, dot segments removed."""

    def merged(base_parts: Column) -> Column:
        directory = F.when(F.element_at(base_parts, -1) == "", base_parts).otherwise(
            F.slice(base_parts, 1, F.size(base_parts) - 1)
        )
        return F.concat(directory, F.split(path, "/", -1))

    def without_gaps(parts: Column) -> Column:
        inner = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda s: s != "")
        return F.when(F.size(parts) < 2, parts).otherwise(
            F.concat(F.slice(parts, 1, 1), inner, F.slice(parts, -1, 1))
        )

    def folded(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.array_join(F.concat(kept, tail), "/")

    segments = F.when(F.startswith(path, F.lit("/")), F.split(path, "/", -1)).otherwise(
        let(let(F.split(base_path, "/", -1), merged), without_gaps)
    )
    return let(segments, folded)


def resolve(base: Column | str, href: Column | str) -> Column:
    """Absolute form of ``href`` found on page ``base``."""
    base, href = _as_col(base), _as_col(href)
    b = split_url(base)
    scheme = F.lower(F.regexp_extract(href, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    suffix = F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    site = F.concat(b.scheme, F.lit("://"), b.netloc)
    base_query = F.when(b.query == "", F.lit("")).otherwise(F.concat(F.lit("?"), b.query))
    rooted = F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("/."))
    return (
        F.when(href == "", base)
        .when(scheme != "", href)
        .when(F.startswith(href, F.lit("//")), F.concat(b.scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("#")), F.concat(site, b.path, base_query, href))
        .when(path == "", F.concat(site, b.path, suffix))
        .when(rooted, F.concat(site, path, suffix))
        .otherwise(
            F.concat(
                site,
                let(
                    _folded_path(b.path, path),
                    lambda p: F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p)),
                ),
                suffix,
            )
        )
    )


def redact(c: Column) -> Column:
    """Mask the password of userinfo and the values of sensitive query keys.

    Userinfo is what stands between ``://`` and ``@``; keys are looked for between
    question marks and ampersands.
    """
    mask = F.lit("***")

    def userinfo(text: Column) -> Column:
        """The password is what lies between the first colon behind ``://`` and the next ``@``, with no slash in between."""
        pieces = F.split(text, "://", -1)

        def hidden(piece: Column, i: Column) -> Column:
            authority = F.substring_index(piece, "/", 1)
            name = F.substring_index(F.substring_index(authority, "@", 1), ":", 1)
            secret = F.substring(F.substring_index(authority, "@", 1), F.length(name) + 2, F.length(authority))
            rest = F.substring(piece, F.length(name) + F.length(secret) + 2, F.length(piece))
            has = (i > 0) & F.contains(authority, F.lit("@")) & (name != "") & (secret != "")
            return F.when(has, F.concat(name, F.lit(":"), mask, rest)).otherwise(piece)

        return F.array_join(F.transform(pieces, hidden), "://")

    def masked(part: Column, j: Column) -> Column:
        """A key stands behind a question mark, or at the start of any part but the first; its value ends with the part."""
        pieces = F.split(part, "[?]", -1)
        keys = F.transform(pieces, lambda piece, i: F.struct(i.alias("i"), F.substring_index(piece, "=", 1).alias("key"), F.contains(piece, F.lit("=")).alias("valued")))
        sensitive = F.filter(keys, lambda k: k["valued"] & ((k["i"] > 0) | (j > 0)) & F.lower(k["key"]).isin(*SENSITIVE_PARAMS))
        first = F.get(sensitive, F.lit(0))
        before = F.transform(F.slice(pieces, 1, F.coalesce(first["i"], F.lit(0))), lambda piece: F.concat(piece, F.lit("?")))
        return F.when(first.isNull(), part).otherwise(F.concat(F.array_join(before, ""), first["key"], F.lit("="), mask))

    def query(text: Column) -> Column:
        return F.array_join(F.transform(F.split(text, "&", -1), masked), "&")

    # Most URLs have neither: only what may hold a secret is taken apart.
    has_userinfo = F.contains(c, F.lit("@")) & F.contains(c, F.lit("://"))
    has_key = F.rlike(F.lower(c), F.lit("[?&](?:" + "|".join(SENSITIVE_PARAMS) + ")="))
    return F.when(has_userinfo, let(userinfo(c), query)).when(has_key, query(c)).otherwise(c)


def path_and_query(url: Column | str) -> Column:
    p = split_url(url)
    return F.when(p.query == "", p.path).otherwise(F.concat(p.path, F.lit("?"), p.query))
