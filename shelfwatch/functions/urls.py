"""URL functions. A URL that can't be read gives null, never an error.

Functions of whole URLs read them as the URL standard does. Only ``scheme``, ``host``, ``path``, ``query``, ``origin`` and ``param``
take URLs that are written in its form already, as ``url_standard``, ``url_resolve`` and the other functions give them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .urlstandard import host_standard, joined, let, url_standard

# Query parameters that only track, and ones that name an image variant and stay.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "gclsrc", "dclid",
    "msclkid", "mc_cid", "mc_eid", "_ga", "_gl", "yclid", "igshid", "ref", "ref_src",
)
VARIANT_PARAMS = (
    "w", "h", "width", "height", "size", "s", "q", "quality", "fm", "format", "fit", "crop", "dpr", "v", "version",
    "rev", "sku", "variant",
)

#: Scheme, authority, path, query with its mark, fragment with its mark.
URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?(#\S*)?$"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@\s]*@)?(\[[^\]/?#\s]*\]|[^/?#:\s]+)"
LOCALE = r"(?i)^/([a-z]{2}(?:-[a-z]{2})?)(/.*)$"
PRIVATE_HOST = (
    r"^(?:localhost|.*\.localhost|.*\.local|.*\.internal|\[?::1\]?|\[?(?:fc|fd|fe80).*|0*(?:0|10|127)(?:\.\d{1,3}){3}"
    r"|169\.254(?:\.\d{1,3}){2}|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2[0-9]|3[01])(?:\.\d{1,3}){2})$"
)
COLLECTION = r"(?i)/collections/([^/?#]+)"
PRODUCT = r"(?i)/products/([^/?#]+)"


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def scheme(u: Column) -> Column:
    return _or_null(F.lower(F.regexp_extract(u, URL, 1)))


def host(u: Column) -> Column:
    return _or_null(F.lower(F.regexp_extract(u, HOST, 1)))


def path(u: Column) -> Column:
    """The path, '/' where it is empty; null for what is no URL."""
    return F.when(u.rlike(URL), F.coalesce(_or_null(F.regexp_extract(u, URL, 3)), F.lit("/")))


def query(u: Column) -> Column:
    """The query without its mark, '' where there is none."""
    return F.when(u.rlike(URL), F.substring(F.regexp_extract(u, URL, 4), 2, 1 << 30))


def origin(u: Column) -> Column:
    """Scheme, host and port, without credentials."""
    bare = F.regexp_replace(F.regexp_extract(u, URL, 2), "^.*@", "")
    return F.when(u.rlike(URL), F.concat(F.lower(F.regexp_extract(u, URL, 1)), F.lit("://"), F.lower(bare)))


def param(u: Column, name: str) -> Column:
    """The first value of a query parameter, null where it is missing."""
    found = F.filter(F.split(query(u), "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1)) == name)
    first = F.get(found, F.lit(0))
    return F.when(first.contains("="), F.substring(first, len(name) + 2, 1 << 30)).when(first.isNotNull(), "")


def url_validate(u: Column) -> Column:
    """Struct (host, error): http and https only; error is INVALID_URL or null."""
    return let(url_standard(u), lambda v: F.struct(host(v).alias("host"), F.when(v.isNull(), "INVALID_URL").alias("error")))


def url_is_private_host(h: Column) -> Column:
    """Loopback, link-local and private networks, by name, numbers in any form or IPv6 address (in brackets or not).

    Any name that starts with fc, fd or fe80 counts, too.
    """
    return let(h, lambda h: F.lower(F.coalesce(host_standard(h), h)).rlike(PRIVATE_HOST))


def url_resolve(raw: Column, base: Column) -> Column:
    """``raw`` against the page's URL, in the standard's form; null for fragments, other schemes and what is no URL."""
    return url_standard(joined(raw, url_standard(base)))


def _with_query(u: Column, params: Column) -> Column:
    """The URL without its fragment and with other parameters."""
    left = F.regexp_replace(F.regexp_replace(u, "#.*$", ""), r"\?.*$", "")
    return F.when(F.size(params) > 0, F.concat(left, F.lit("?"), F.array_join(params, "&"))).otherwise(left)


def _params(u: Column) -> Column:
    return F.filter(F.split(query(u), "&"), lambda p: p != "")


def url_strip_tracking(u: Column) -> Column:
    """Drop tracking parameters and the fragment; order and repeats of the others stay."""

    def stays(p: Column) -> Column:
        name = F.lower(F.split_part(p, F.lit("="), F.lit(1)))
        return name.isin(*VARIANT_PARAMS) | ~(name.isin(*TRACKING_PARAMS) | name.startswith("utm_"))

    return let(url_standard(u), lambda u: F.when(u.rlike(URL), _with_query(u, F.filter(_params(u), stays))))


def url_strip_locale(p: Column) -> Column:
    """Remove one leading language or language-country segment of a path."""
    return F.when(p.rlike(LOCALE), F.regexp_extract(p, LOCALE, 2)).otherwise(p)


def url_locale_prefix(p: Column) -> Column:
    return F.when(p.rlike(LOCALE), F.concat(F.lit("/"), F.lower(F.regexp_extract(p, LOCALE, 1)))).otherwise("")


def collection_handle(u: Column) -> Column:
    return let(url_standard(u), lambda u: _or_null(F.lower(F.regexp_extract(url_strip_locale(path(u)), COLLECTION, 1))))


def host_same_ignoring_www(a: Column, b: Column) -> Column:
    bare = lambda h: F.regexp_replace(F.lower(h), r"^www\.", "")
    return bare(a) == bare(b)


def set_param(u: Column, name: str, value: Column) -> Column:
    """Give a parameter one value, in place of its first occurrence or at the end; null removes it."""
    is_it = lambda p: F.split_part(p, F.lit("="), F.lit(1)) == name
    pair = F.concat(F.lit(f"{name}="), value)

    def changed(params: Column, pair: Column, value: Column) -> Column:
        first = F.array_position(F.transform(params, is_it), True) - 1
        replaced = F.filter(F.transform(params, lambda p, i: F.when(i == first, pair).when(~is_it(p), p)), lambda p: p.isNotNull())
        dropped = F.filter(params, lambda p: ~is_it(p))
        return F.when(value.isNull(), dropped).when(F.exists(params, is_it), replaced).otherwise(F.array_append(params, pair))

    def changed_url(params: Column, u: Column) -> Column:
        return _with_query(u, params)

    return let(let(_params(u), changed, pair, value), changed_url, u)


def safe_redirect_target(requested: Column, location: Column) -> Column:
    """Where a redirect may lead: the same host and collection; lost sort_by and page are put back. Else null."""

    def sorted_again(target: Column, sort: Column) -> Column:
        lost = (F.coalesce(sort, F.lit("")) != "") & ~param(target, "sort_by").eqNullSafe(sort)
        return F.when(lost, set_param(target, "sort_by", sort)).otherwise(target)

    def paged_again(target: Column, page: Column) -> Column:
        lost = (F.coalesce(page, F.lit("")) != "") & (F.coalesce(param(target, "page"), F.lit("")) == "")
        return F.when(lost, set_param(target, "page", page)).otherwise(target)

    def followed(target: Column, requested: Column) -> Column:
        handle = lambda u: F.lower(F.regexp_extract(url_strip_locale(path(u)), COLLECTION, 1))
        same = host_same_ignoring_www(host(requested), host(target)) & (handle(requested) != "") & (handle(requested) == handle(target))
        final = let(let(target, sorted_again, param(requested, "sort_by")), paged_again, param(requested, "page"))
        return F.when(same, let(final, lambda final, requested: F.when(final != requested, final), requested))

    return let(url_resolve(location, requested), followed, url_standard(requested))


def redirect_away(target: Column, landed: Column) -> Column:
    """The path differs but for locale and a closing slash, or the requested sort order is lost."""
    plain = lambda u: F.regexp_replace(url_strip_locale(path(u)), "/+$", "")
    lost = lambda target, landed: param(target, "sort_by").isNotNull() & ~param(landed, "sort_by").eqNullSafe(param(target, "sort_by"))
    return let(url_standard(target), lambda target, landed: (plain(target) != plain(landed)) | lost(target, landed), url_standard(landed))


def product_url_normalize(href: Column, base: Column) -> Column:
    """``<locale>/products/<handle>`` on the page's own host, without query and fragment; null for other links."""

    def normal(u: Column, base: Column) -> Column:
        handle = F.regexp_extract(path(u), PRODUCT, 1)
        return F.when((host(u) == host(base)) & (handle != ""), F.concat(origin(u), url_locale_prefix(path(u)), F.lit("/products/"), handle))

    return let(url_resolve(href, base), normal, url_standard(base))


def product_url_normalize_keep_prefix(href: Column, base: Column) -> Column:
    """The path up to and with the handle, as linked."""

    def normal(u: Column, base: Column) -> Column:
        kept = F.regexp_extract(path(u), r"(?i)^(.*?/products/[^/?#]+)", 1)
        return F.when((host(u) == host(base)) & (kept != ""), F.concat(origin(u), kept))

    return let(url_resolve(href, base), normal, url_standard(base))


def product_identity(u: Column) -> Column:
    """Struct (product_key, handle): the decoded, lower-cased handle is the identity; else the URL is."""

    def named(v: Column, u: Column) -> Column:
        raw = F.regexp_extract(path(v), PRODUCT, 1)
        plain = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
        handle = _or_null(F.lower(plain))
        return F.struct(F.coalesce(F.concat(F.lit("handle:"), handle), u).alias("product_key"), handle.alias("handle"))

    return let(url_standard(u), named, u)


def listing_key(u: Column) -> Column:
    """``host|path`` and the sort order if there is one."""

    def key(u: Column) -> Column:
        bare = F.regexp_replace(path(u), "/+$", "")
        sort = _or_null(param(u, "sort_by"))
        return F.concat_ws("|", host(u), F.when(bare == "", "/").otherwise(bare), F.concat(F.lit("sort_by="), sort))

    return let(url_standard(u), key)


def paginated_url(u: Column, page: Column) -> Column:
    """The URL of a page of a listing; the first page has no page parameter."""
    return let(url_standard(u), lambda u, page: F.when(u.rlike(URL), set_param(u, "page", F.when(page > 1, page.cast("string")))), page)


def feed_url(u: Column) -> Column:
    """Struct (feed, root_ok): the collection's product feed, and whether the shop's own feed can stand in."""

    def feeds(u: Column) -> Column:
        collection = F.regexp_extract(path(u), r"(?i)^(.*?/collections/[^/?#]+)", 1)
        feed = F.when(collection != "", F.concat(origin(u), collection, F.lit("/products.json")))
        return F.struct(feed.alias("feed"), F.when(collection != "", collection.rlike(r"(?i)/collections/(?:all|vendors|types)$")).alias("root_ok"))

    return let(url_standard(u), feeds)


def product_url_kind(u: Column) -> Column:
    """Struct (kind, reason): js, json or page for https product paths without port and credentials."""

    def told(u: Column) -> Column:
        authority = F.regexp_extract(u, URL, 2)
        reason = (
            F.when(u.isNull(), "not_a_url")
            .when(scheme(u) != "https", "not_https")
            .when(authority.contains("@"), "credentials")
            .when(authority.rlike(r":[0-9]+$"), "port")
            .when(~path(u).rlike(r"(?i)^(?:/[a-z]{2}(?:-[a-z]{2})?)?/products/[^/]+/?$"), "not_a_product_path")
        )
        ending = F.when(path(u).rlike(r"(?i)\.js$"), "js").when(path(u).rlike(r"(?i)\.json$"), "json").otherwise("page")
        return F.struct(F.when(reason.isNull(), ending).alias("kind"), reason.alias("reason"))

    return let(url_standard(u), told)
