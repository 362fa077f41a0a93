"""Queries of the URL and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import discovery
from .registry import columns, register
from .views import AS_OF

# Building blocks of the SQL side; an expression e is a column name or SQL.
_URL = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?(#\S*)?$'"
_HOST = r"'^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@\s]*@)?(\[[^\]/?#\s]*\]|[^/?#:\s]+)'"


def _is(e):
    return f"regexp_matches({e}, {_URL})"


def _scheme(e):
    return f"nullif(lower(regexp_extract({e}, {_URL}, 1)), '')"


def _host(e):
    return f"nullif(lower(regexp_extract({e}, {_HOST}, 1)), '')"


def _path(e):
    return f"CASE WHEN {_is(e)} THEN coalesce(nullif(regexp_extract({e}, {_URL}, 3), ''), '/') END"


def _query(e):
    return f"CASE WHEN {_is(e)} THEN substr(regexp_extract({e}, {_URL}, 4), 2) END"


def _origin(e):
    return f"CASE WHEN {_is(e)} THEN lower(regexp_extract({e}, {_URL}, 1)) || '://' || lower(regexp_extract({e}, {_URL}, 2)) END"


def _param(e, name):
    return f"(CASE WHEN regexp_matches('&' || ({_query(e)}) || '&', '&{name}[=&]') THEN regexp_extract('&' || ({_query(e)}) || '&', '&{name}(?:=([^&]*))?&', 1) END)"


def _no_locale(e):
    return f"(CASE WHEN regexp_matches({e}, '(?i)^/([a-z]{{2}}(?:-[a-z]{{2}})?)(/.*)$') THEN regexp_extract({e}, '(?i)^/([a-z]{{2}}(?:-[a-z]{{2}})?)(/.*)$', 2) ELSE {e} END)"


def _locale(e):
    return f"(CASE WHEN regexp_matches({e}, '(?i)^/([a-z]{{2}}(?:-[a-z]{{2}})?)(/.*)$') THEN '/' || lower(regexp_extract({e}, '(?i)^/([a-z]{{2}}(?:-[a-z]{{2}})?)(/.*)$', 1)) ELSE '' END)"


def _collection(e):
    return f"nullif(lower(regexp_extract({_no_locale('(' + _path(e) + ')')}, '(?i)/collections/([^/?#]+)', 1)), '')"


_BAD = r"(trim(raw) = '' OR starts_with(trim(raw), '#') OR (regexp_matches(trim(raw), '^[A-Za-z][A-Za-z0-9+.\-]*:') AND NOT regexp_matches(trim(raw), '(?i)^https?://')))"


def _undotted(p):
    """A path without dot segments, by rewriting it: single dots go, then up to five pairs of a name and two dots, then dots at the root."""
    p = rf"regexp_replace(regexp_replace({p}, '/\.(?:/\.)*(/|$)', '/', 'g'), '/\.(/|$)', '/', 'g')"
    for _ in range(5):
        p = rf"regexp_replace({p}, '/(?:[^/.][^/]*|\.[^/.][^/]*|\.\.[^/]+)/\.\.(/|$)', '/')"
    return rf"regexp_replace({p}, '^(?:/\.\.)+(/|$)', '/')"


def _standard(u):
    """An address as the URL standard writes it, as far as the given tables ask for it: dot segments, and characters beyond printable ASCII as octets."""
    dotted = _undotted(r"regexp_extract(v, '^[A-Za-z][^:/]*://[^/?#]+([^?#]*)', 1)")
    whole = rf"regexp_extract(v, '^[A-Za-z][^:/]*://[^/?#]+') || {dotted} || regexp_extract(v, '^[^?#]*(.*)$', 1)"
    octets = r"array_to_string(list_transform(string_split(v, ''), lambda c: CASE WHEN regexp_matches(c, '[^\x21-\x7e]') THEN url_encode(c) ELSE c END), '')"
    plain = rf"(list_transform([{u}], lambda v: CASE WHEN regexp_matches(v, '^[^?#]*/\.\.?([/?#]|$)') THEN {whole} ELSE v END)[1])"
    return rf"(list_transform([{plain}], lambda v: CASE WHEN regexp_matches(v, '[^\x21-\x7e]') THEN {octets} ELSE v END)[1])"


def _resolve(raw, base):
    return _standard(_joined(raw, base))


def _joined(raw, base):
    bad = _BAD.replace("raw", raw)
    return f"""(CASE WHEN {bad} OR ({_origin(base)}) IS NULL THEN NULL WHEN regexp_matches(trim({raw}), '(?i)^https?://') THEN trim({raw})
      WHEN starts_with(trim({raw}), '//') THEN {_scheme(base)} || ':' || trim({raw}) WHEN starts_with(trim({raw}), '/') THEN ({_origin(base)}) || trim({raw})
      WHEN starts_with(trim({raw}), '?') THEN ({_origin(base)}) || ({_path(base)}) || trim({raw}) ELSE ({_origin(base)}) || regexp_replace(({_path(base)}), '[^/]*$', '') || trim({raw}) END)"""


c = F.col
_STANDARD = f"(SELECT * REPLACE ({_standard('url')} AS url) FROM full_urls)"
_bare = r"regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', '')"
_private = r"""(h IN ('localhost', '::1', '[::1]') OR h LIKE '%.localhost' OR h LIKE '%.local' OR h LIKE '%.internal' OR h LIKE 'fc%' OR h LIKE 'fd%' OR h LIKE 'fe80%' OR h LIKE '[fc%' OR h LIKE '[fd%' OR h LIKE '[fe80%'
  OR (len(string_split(h, '.')) = 4 AND len(list_filter(string_split(h, '.'), lambda n: regexp_full_match(n, '[0-9]{1,3}'))) = 4
      AND (try_cast(string_split(h, '.')[1] AS INT) IN (0, 10, 127) OR h LIKE '169.254.%' OR h LIKE '192.168.%' OR (h LIKE '172.%' AND try_cast(string_split(h, '.')[2] AS INT) BETWEEN 16 AND 31))))"""

columns("url_validate", "full_urls", ("url_id",), {
    "host": (lambda: U.url_validate(c("url"))["host"], f"CASE WHEN {_scheme('trim(url)')} IN ('http', 'https') THEN {_host('trim(url)')} END"),
    "error": (lambda: U.url_validate(c("url"))["error"], f"CASE WHEN {_scheme('trim(url)')} IN ('http', 'https') AND {_host('trim(url)')} IS NOT NULL THEN NULL ELSE 'INVALID_URL' END"),
})
register("url_is_private_host", ("full_urls",), lambda d: d.select("url_id", U.url_is_private_host(U.host(c("url"))).alias("private")),
         f"SELECT url_id, {_private} AS private FROM (SELECT url_id, {_host('url')} AS h FROM full_urls)")
register("url_domain_allowed", ("full_urls", "part"),
         lambda d, p: discovery.url_domain_allowed(d, p.where("p_partkey <= 25").select(F.concat(F.lit("shop"), F.when(c("p_partkey") > 1, c("p_partkey").cast("string")).otherwise(""), F.lit(".example.com")).alias("domain")), U.host(c("url"))).select("url_id", "url"),
         f"SELECT url_id, url FROM (SELECT url_id, url, {_host('url')} AS h FROM full_urls) u WHERE NOT {_private} AND EXISTS (SELECT 1 FROM part WHERE p_partkey <= 25 AND (h = 'shop' || CASE WHEN p_partkey > 1 THEN p_partkey::VARCHAR ELSE '' END || '.example.com' OR h LIKE '%.shop' || CASE WHEN p_partkey > 1 THEN p_partkey::VARCHAR ELSE '' END || '.example.com'))")
columns("url_resolve", "shop_urls", ("url_id",), {"resolved": (lambda: U.url_resolve(c("raw"), c("base")), _resolve("raw", "base"))})
columns("url_strip_tracking", "full_urls", ("url_id",), rows=_STANDARD, made={"stripped": (lambda: U.url_strip_tracking(c("url")), f"""CASE WHEN {_is('url')} THEN {_bare} || CASE WHEN len(list_filter(string_split({_query('url')}, '&'), lambda p: p <> '' AND NOT (lower(split_part(p, '=', 1)) IN ('fbclid','gclid','gclsrc','dclid','msclkid','mc_cid','mc_eid','_ga','_gl','yclid','igshid','ref','ref_src') OR lower(p) LIKE 'utm~_%' ESCAPE '~'))) > 0
   THEN '?' || array_to_string(list_filter(string_split({_query('url')}, '&'), lambda p: p <> '' AND NOT (lower(split_part(p, '=', 1)) IN ('fbclid','gclid','gclsrc','dclid','msclkid','mc_cid','mc_eid','_ga','_gl','yclid','igshid','ref','ref_src') OR lower(p) LIKE 'utm~_%' ESCAPE '~')), '&') ELSE '' END END""")})
columns("url_strip_locale", "full_urls", ("url_id",), {"path": (lambda: U.url_strip_locale(U.path(c("url"))), _no_locale("(" + _path("url") + ")"))})
columns("url_locale_prefix", "full_urls", ("url_id",), {"locale": (lambda: U.url_locale_prefix(U.path(c("url"))), _locale("(" + _path("url") + ")"))})
columns("collection_handle", "full_urls", ("url_id",), rows=_STANDARD, made={"handle": (lambda: U.collection_handle(c("url")), _collection("url"))})
columns("host_same_ignoring_www", "full_urls", ("url_id",), {"same": (lambda: U.host_same_ignoring_www(U.host(c("url")), F.lit("WWW.shop.example.com")), f"regexp_replace({_host('url')}, '^www\\.', '') = 'shop.example.com'")})
columns("redirect_away", "redirects", ("redirect_id",), {"away": (lambda: U.redirect_away(c("requested"), U.url_resolve(c("location"), c("requested"))),
    f"""(regexp_replace({_no_locale('(' + _path('requested') + ')')}, '/+$', '') <> regexp_replace({_no_locale('(' + _path(_resolve('location', 'requested')) + ')')}, '/+$', '')) OR coalesce({_param(_resolve('location', 'requested'), 'sort_by')}, '') <> 'best-selling'""")})
register("safe_redirect_target", ("redirects",), lambda d: d.select("redirect_id", U.safe_redirect_target(c("requested"), c("location")).alias("target")), f"""
WITH r AS (SELECT redirect_id, requested, {_resolve('location', 'requested')} AS t FROM redirects),
s AS (SELECT *, {_param('t', 'sort_by')} AS sort FROM r WHERE regexp_replace({_host('t')}, '^www\\.', '') = 'shop.example.com' AND {_collection('t')} = 'hats'),
u AS (SELECT redirect_id, requested, CASE WHEN sort = 'best-selling' THEN t WHEN sort IS NOT NULL THEN regexp_replace(t, 'sort_by=[^&]*', 'sort_by=best-selling') WHEN t LIKE '%?%' THEN t || '&sort_by=best-selling' ELSE t || '?sort_by=best-selling' END AS t FROM s),
f AS (SELECT redirect_id, requested, CASE WHEN {_param('requested', 'page')} IS NOT NULL AND {_param('t', 'page')} IS NULL THEN t || '&page=' || {_param('requested', 'page')} ELSE t END AS t FROM u)
SELECT r.redirect_id, CASE WHEN f.t <> f.requested THEN f.t END AS target FROM r LEFT JOIN f ON r.redirect_id = f.redirect_id""")
_u = _resolve("raw", "base")
register("product_url_normalize", ("shop_urls",), lambda d: d.select("url_id", U.product_url_normalize(c("raw"), c("base")).alias("product_url")), f"""
WITH r AS (SELECT url_id, base, {_u} AS u FROM shop_urls) SELECT url_id, CASE WHEN {_host('u')} = {_host('base')} AND regexp_extract(({_path('u')}), '(?i)/products/([^/?#]+)', 1) <> '' THEN ({_origin('u')}) || {_locale('(' + _path('u') + ')')} || '/products/' || regexp_extract(({_path('u')}), '(?i)/products/([^/?#]+)', 1) END AS product_url FROM r""")
register("product_url_normalize_keep_prefix", ("shop_urls",), lambda d: d.select("url_id", U.product_url_normalize_keep_prefix(c("raw"), c("base")).alias("product_url")), f"""
WITH r AS (SELECT url_id, base, {_u} AS u FROM shop_urls) SELECT url_id, CASE WHEN {_host('u')} = {_host('base')} AND regexp_extract(({_path('u')}), '(?i)/products/([^/?#]+)', 1) <> '' THEN ({_origin('u')}) || regexp_extract(({_path('u')}), '(?i)^(.*?/products/[^/?#]+)', 1) END AS product_url FROM r""")
columns("product_identity", "full_urls", ("url_id",), rows=_STANDARD, made={
    "product_key": (lambda: U.product_identity(c("url"))["product_key"], f"coalesce('handle:' || nullif(lower(CASE WHEN regexp_extract(({_path('url')}), '(?i)/products/([^/?#]+)', 1) LIKE '%~%ZZ%' ESCAPE '~' THEN regexp_extract(({_path('url')}), '(?i)/products/([^/?#]+)', 1) ELSE url_decode(regexp_extract(({_path('url')}), '(?i)/products/([^/?#]+)', 1)) END), ''), url)"),
    "handle": (lambda: U.product_identity(c("url"))["handle"], f"nullif(lower(CASE WHEN regexp_extract(({_path('url')}), '(?i)/products/([^/?#]+)', 1) LIKE '%~%ZZ%' ESCAPE '~' THEN regexp_extract(({_path('url')}), '(?i)/products/([^/?#]+)', 1) ELSE url_decode(regexp_extract(({_path('url')}), '(?i)/products/([^/?#]+)', 1)) END), '')"),
})
columns("listing_key", "full_urls", ("url_id",), rows=_STANDARD, made={"listing_key": (lambda: U.listing_key(c("url")), f"concat_ws('|', {_host('url')}, CASE WHEN regexp_replace(({_path('url')}), '/+$', '') = '' THEN '/' ELSE regexp_replace(({_path('url')}), '/+$', '') END, 'sort_by=' || nullif({_param('url', 'sort_by')}, ''))")})
columns("paginated_url", "full_urls", ("url_id",), rows=_STANDARD, made={"page_url": (lambda: U.paginated_url(c("url"), c("url_id") % 3 + 1), f"""CASE WHEN {_is('url')} THEN CASE
  WHEN url_id % 3 + 1 > 1 AND {_param('url', 'page')} IS NOT NULL THEN regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])page=[^&]*', '\\1page=' || (url_id % 3 + 1)::VARCHAR)
  WHEN url_id % 3 + 1 > 1 AND url LIKE '%?%' THEN regexp_replace(url, '#.*$', '') || '&page=' || (url_id % 3 + 1)::VARCHAR
  WHEN url_id % 3 + 1 > 1 THEN regexp_replace(url, '#.*$', '') || '?page=' || (url_id % 3 + 1)::VARCHAR
  ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])page=[^&]*', '\\1'), '[?&]+$', ''), '\\?&', '?') END END""")})
columns("feed_url", "full_urls", ("url_id",), rows=_STANDARD, made={
    "feed": (lambda: U.feed_url(c("url"))["feed"], f"CASE WHEN regexp_extract(({_path('url')}), '(?i)^(.*?/collections/[^/?#]+)', 1) <> '' THEN ({_origin('url')}) || regexp_extract(({_path('url')}), '(?i)^(.*?/collections/[^/?#]+)', 1) || '/products.json' END"),
    "root_ok": (lambda: U.feed_url(c("url"))["root_ok"], f"CASE WHEN {_collection('url')} IS NOT NULL THEN {_collection('url')} IN ('all', 'vendors', 'types') END"),
})
columns("product_url_kind", "full_urls", ("url_id",), rows=_STANDARD, made={
    "kind": (lambda: U.product_url_kind(c("url"))["kind"], f"CASE WHEN {_scheme('url')} = 'https' AND NOT regexp_matches(regexp_extract(url, {_URL}, 2), '[@:]') AND regexp_matches(({_path('url')}), '(?i)^(?:/[a-z]{{2}}(?:-[a-z]{{2}})?)?/products/[^/]+/?$') THEN CASE WHEN lower(({_path('url')})) LIKE '%.js' THEN 'js' WHEN lower(({_path('url')})) LIKE '%.json' THEN 'json' ELSE 'page' END END"),
    "reason": (lambda: U.product_url_kind(c("url"))["reason"], f"CASE WHEN NOT {_is('url')} THEN 'not_a_url' WHEN {_scheme('url')} <> 'https' THEN 'not_https' WHEN regexp_extract(url, {_URL}, 2) LIKE '%@%' THEN 'credentials' WHEN regexp_extract(url, {_URL}, 2) LIKE '%:%' THEN 'port' WHEN NOT regexp_matches(({_path('url')}), '(?i)^(?:/[a-z]{{2}}(?:-[a-z]{{2}})?)?/products/[^/]+/?$') THEN 'not_a_product_path' END"),
})

_srcset = "'/a-' || p_partkey::VARCHAR || '.jpg 1x,  /b.jpg 2x, , /c.jpg'"
register("srcset_urls", ("part",), lambda d: d.select("p_partkey", F.array_join(T.srcset_urls(F.concat(F.lit("/a-"), c("p_partkey").cast("string"), F.lit(".jpg 1x,  /b.jpg 2x, , /c.jpg"))), "|").alias("urls")),
         f"SELECT p_partkey, array_to_string(list_filter(list_transform(string_split({_srcset}, ','), lambda x: regexp_extract(x, '^\\s*(\\S+)', 1)), lambda x: x <> ''), '|') AS urls FROM part")
columns("decode_entities", "pages", ("page_id",), {
    "decoded": (lambda: F.md5(T.decode_entities(c("html"))), "md5(replace(replace(replace(replace(replace(replace(html, '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'))"),
    "amp_first": (lambda: F.md5(T.decode_entities(c("html"), True)), "md5(replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'))"),
})
columns("clean_text", "pages", ("page_id",), {"cleaned": (lambda: F.md5(T.clean_text(c("html"), True)), "md5(nullif(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\\s\\x{00a0}\\x{feff}]+', ' ', 'g')), ''))")})
columns("normalize_for_compare", "documents", ("doc_id",), {"compared": (lambda: F.md5(T.normalize_for_compare(c("text"))), "md5(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')))")})
columns("sanitize_domain", "full_urls", ("url_id",), {"segment": (lambda: T.sanitize_domain(U.host(c("url"))), f"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({_host('url')}, '[^a-z0-9.-]', '-', 'g'), '-+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'unknown-domain')")})
columns("sanitize_segment", "documents", ("doc_id",), {"segment": (lambda: T.sanitize_segment(c("text")), "coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), ''), 'item')")})
columns("ext_from_content_type", "fetch_log", ("page_id", "attempt"), {"ext": (lambda: T.ext_from_content_type(c("content_type")), "CASE WHEN content_type ILIKE '%jpeg%' OR content_type ILIKE '%jpg%' THEN 'jpg' WHEN content_type ILIKE '%png%' THEN 'png' WHEN content_type ILIKE '%webp%' THEN 'webp' WHEN content_type ILIKE '%gif%' THEN 'gif' WHEN content_type ILIKE '%avif%' THEN 'avif' WHEN content_type ILIKE '%svg%' THEN 'svg' ELSE 'jpg' END")})
columns("run_id", "runs", ("run_id",), {"made": (lambda: T.run_id(c("created_at"), c("domain"), c("run_id")), "strftime(created_at, '%Y%m%dt%H%M%Sz') || '-' || domain || '-' || substr(sha256(run_id), 1, 8)")})
_seg = lambda e: f"nullif(substr(regexp_replace(regexp_replace(regexp_replace(lower({e}), '[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '')"
columns("image_label", "image_meta", ("image_id",), {"label": (lambda: T.image_label(c("alt"), c("url"), F.lit("img")), f"coalesce({_seg('alt')}, {_seg(chr(39).join(['regexp_replace(regexp_extract(url, ', '([^/?#]+)(?:[?#].*)?$', ', 1), ', chr(92) + '.[A-Za-z0-9]+$', ', ', '', ')']))}, 'img')")})
columns("redact_credentials", "full_urls", ("url_id",), {"line": (lambda: T.redact_credentials(F.concat(F.lit("via http://me:pw@proxy.example.com:80 to "), c("url"))), r"regexp_replace('via http://me:pw@proxy.example.com:80 to ' || url, '([A-Za-z][A-Za-z0-9+.\-]*://)[^/@\s]+@', '\1***@', 'g')")})
columns("retry_after_seconds", "fetch_log", ("page_id", "attempt"), {"seconds": (lambda: T.retry_after_seconds(c("retry_after"), F.lit(AS_OF).cast("timestamp")), f"CASE WHEN regexp_matches(trim(retry_after), '^[0-9]{{1,9}}$') THEN trim(retry_after)::BIGINT WHEN retry_after LIKE '%GMT' THEN greatest(0, epoch(strptime(substr(retry_after, 6), '%d %b %Y %H:%M:%S GMT'))::BIGINT - epoch(TIMESTAMP '{AS_OF}')::BIGINT) END")})
columns("clamp_params", "part", ("p_partkey",), {
    "max_products": (lambda: T.clamp_params(F.when(c("p_partkey") % 7 != 0, c("p_size") * 11 - 40), 1, 250, 100), "greatest(1, least(250, coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_size * 11 - 40 END, 100)))"),
    "days": (lambda: T.clamp_params(c("p_size") * 9, 1, 365, 30), "greatest(1, least(365, p_size * 9))"),
})
columns("email_normalize", "accounts", ("user_id",), {"email": (lambda: T.email_normalize(F.when(c("user_id") % 2 == 0, c("email")), F.lit(" A@B.C ")), "lower(trim(CASE WHEN user_id % 2 = 0 THEN email ELSE ' A@B.C ' END))")})
