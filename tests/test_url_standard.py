"""Addresses as the URL standard writes them. Expected values are worked out from the standard's text."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions import urls as U
from shelfwatch.functions import urlstandard as S

SAME = ["https://a.b/", "http://shop.example.com/products/x?y=1#z", "https://a_b.example/%7Ex/%c3%a9?q=%zz", "https://a.b/;p=1,2/'x'(y)!*$&+=:@[]|~", "https://a.b:8443/x", "http://u:p@a.b/", "https://a.b/?#", "https://xn--bcher-kva.example/", "https://a.b//c///d", "https://localhost/x"]
WRITTEN = [
    ("HTTPS://EX.com/A", "https://ex.com/A"), ("http://EX.com:80/a", "http://ex.com/a"), ("https://a.b:443", "https://a.b/"), ("https://a.b:80/", "https://a.b:80/"), ("https://a.b:0080/", "https://a.b:80/"), ("http://a.b:/x", "http://a.b/x"),
    ("https://a.b", "https://a.b/"), ("https://a.b?x", "https://a.b/?x"), ("https://a.b#x", "https://a.b/#x"), (" \t https://a.b/x \n", "https://a.b/x"), ("ht\ntps://a\t.b/x\ry", "https://a.b/xy"),
    (r"https:\\a.b\c\d?e\f#g\h", r"https://a.b/c/d?e\f#g\h"), (r"https://shop.example.com\@evil.example.org/", "https://shop.example.com/@evil.example.org/"), ("https:a.b/x", "https://a.b/x"), ("https:////a.b/x", "https://a.b/x"),
    ("https://a.b/é", "https://a.b/%C3%A9"), ("https://a.b/a b?c d#e f", "https://a.b/a%20b?c%20d#e%20f"), ("https://a.b/\"<>`{}^", "https://a.b/%22%3C%3E%60%7B%7D%5E"), ("https://a.b/?'\"<>`{}^|", "https://a.b/?%27%22%3C%3E`{}^|"), ("https://a.b/#'\"<>`{}^", "https://a.b/#'%22%3C%3E%60{}^"), ("https://a.b/\U0001f600\x01\x7f", "https://a.b/%F0%9F%98%80%01%7F"),
    ("https://a.b/x/../y/./z", "https://a.b/y/z"), ("https://a.b/../../x", "https://a.b/x"), ("https://a.b/x/%2E%2e/y", "https://a.b/y"), ("https://a.b/x/.%2e", "https://a.b/"), ("https://a.b/x/.", "https://a.b/x/"), ("https://a.b/x?../y", "https://a.b/x?../y"), ("https://a.b//../x", "https://a.b/x"), (r"https://a.b/x\..\y", "https://a.b/y"),
    ("https://user@a.b/", "https://user@a.b/"), ("https://user:@a.b/", "https://user@a.b/"), ("https://:@a.b/", "https://a.b/"), ("https://:pw@a.b/", "https://:pw@a.b/"), ("https://a@b@c.d/", "https://a%40b@c.d/"), ("https://U:p:q@C.d/", "https://U:p%3Aq@c.d/"),
    ("http://2130706433/", "http://127.0.0.1/"), ("http://127.1/", "http://127.0.0.1/"), ("http://0x7f.0.0x1/", "http://127.0.0.1/"), ("http://0177.0.0.01/", "http://127.0.0.1/"), ("http://10.258/", "http://10.0.1.2/"), ("http://1.2.3.4./", "http://1.2.3.4/"), ("http://0/", "http://0.0.0.0/"), ("http://0x/", "http://0.0.0.0/"), ("http://4294967295", "http://255.255.255.255/"), ("http://１２７.0.0.1/", "http://127.0.0.1/"),
    ("http://[::1]/", "http://[::1]/"), ("http://[0:0:0:0:0:0:0:1]:80/", "http://[::1]/"), ("http://[2001:DB8::0:0:1]/", "http://[2001:db8::1]/"), ("http://[1:0:0:2:0:0:0:3]/", "http://[1:0:0:2::3]/"), ("http://[::ffff:127.0.0.1]/", "http://[::ffff:7f00:1]/"), ("http://[1::]:8080/", "http://[1::]:8080/"), ("http://[1:2:0:4:5:6:7:8]/", "http://[1:2:0:4:5:6:7:8]/"),
    ("https://BÜCHER.example/", "https://xn--bcher-kva.example/"), ("https://straße.de/", "https://xn--strae-oqa.de/"), ("https://例え。テスト/", "https://xn--r8jz45g.xn--zckzah/"), ("https://ｅｘ.com/", "https://ex.com/"), ("https://a%2eb/", "https://a.b/"), ("https://☃.net/", "https://xn--n3h.net/"), ("https://ex­ample.com/", "https://example.com/"), ("https://b%C3%BCcher.example/", "https://xn--bcher-kva.example/"),
]
NONE = [None, "", "x", "/x", "//a.b", "ftp://a.b/", "mailto:a@b", "https://", "https:///", "https://?x", "https://a b/", "https://a.b:99999/", "https://a.b:x/", "https://a%zz/", "https://a<b/", "https://a^b/", "https://a|b/", "http://256.0.0.1/", "http://1.2.3.4.5/", "http://4294967296/", "http://1.2.3.08/", "http://[::1/", "http://[:1]/", "http://[1::2::3]/", "http://[1:2:3]/", "http://[::12345]/", "http://[::1.2.3.256]/", "http://x@/", "http://a.b:80:80/"]


def run(spark, rows, made, names="u string"):
    return [r[0] for r in spark.createDataFrame(rows, f"k int, {names}").orderBy("k").select(made).collect()]


def test_written_forms(spark):
    cases = [(u, u) for u in SAME] + WRITTEN + [(u, None) for u in NONE]
    got = run(spark, [(k, u) for k, (u, _) in enumerate(cases)], S.url_standard(F.col("u")))
    assert [(u, g) for (u, _), g in zip(cases, got, strict=True)] == cases
    again = run(spark, list(enumerate(got)), S.url_standard(F.col("u")))
    assert again == got  # what is written is read as itself
    plain = run(spark, list(enumerate(SAME[:4])), F.col("u").rlike(S.PLAIN))
    assert all(plain)  # these aren't taken apart


def test_punycode_equals_plain_form(spark):
    rng = random.Random(9)
    labels = ["".join(rng.choice("abcxyz019-éüßжд例え漢\U0001f600ñ") for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    labels += ["ü" * 50, "é", "漢字" * 9, "a" * 40 + "\U0010fffd"]
    plain = lambda s: s if s.isascii() else "xn--" + s.encode("punycode").decode()
    assert run(spark, list(enumerate(labels)), S.punycode(F.col("u"))) == [plain(s) for s in labels]


def test_ipv6_equals_plain_form(spark):
    rng = random.Random(5)
    hosts = []
    for _ in range(400):
        pieces = [rng.choice(("0", "0", "0", "00", "1", "ab", "00f0", "ffff")) for _ in range(8)]
        at, n = rng.randrange(8), rng.randrange(4)
        text = ":".join(pieces)
        if n and at + n <= 8:
            text = ":".join(pieces[:at]) + "::" + ":".join(pieces[at + n :])
        hosts.append(text)
    hosts += ["::", "::1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", ":::", "1:", "1:2:3:4:5:6:7:8:9", "", "g::", "1:2:3:4:5:6:7:1.2.3.4"]

    def plain(s):
        try:
            octets = ipaddress.IPv6Address(s).packed
        except ValueError:
            return None
        n = [f"{octets[k] * 256 + octets[k + 1]:x}" for k in range(0, 16, 2)]
        runs = [(-k, a) for a in range(8) for k in range(2, 9 - a) if set(n[a : a + k]) == {"0"}]
        if not runs:
            return f"[{':'.join(n)}]"
        k, a = min(runs)
        return f"[{':'.join(n[:a])}::{':'.join(n[a - k :])}]"

    assert run(spark, [(k, f"[{h}]") for k, h in enumerate(hosts)], S.ipv6(F.col("u"))) == [plain(h) for h in hosts]


BASE = "https://u:p@Shop.example.com:443/en/collections/hats?sort_by=x#y"
RESOLVED = [
    ("/a", "https://u:p@shop.example.com/a"), ("a", "https://u:p@shop.example.com/en/collections/a"), ("../a", "https://u:p@shop.example.com/en/a"), ("?q", "https://u:p@shop.example.com/en/collections/hats?q"), ("//C.d/e", "https://c.d/e"), (r"/\evil.example.org/x", "https://evil.example.org/x"), (r"\\evil.example.org/x", "https://evil.example.org/x"), (r"\a\..\b", "https://u:p@shop.example.com/b"),
    ("https:a", "https://u:p@shop.example.com/en/collections/a"), ("https:/a", "https://u:p@shop.example.com/a"), ("http:a", "http://a/"), ("HTTP://A:80/é", "http://a/%C3%A9"), (" a b ", "https://u:p@shop.example.com/en/collections/a%20b"), ("a:b", None), ("#x", None), ("", None), (" ", None), ("tel:1", None), ("javascript:x", None), (None, None), ("///c.d/e", "https://c.d/e"), ("./", "https://u:p@shop.example.com/en/collections/"), (".", "https://u:p@shop.example.com/en/collections/"), ("é?ü#ß", "https://u:p@shop.example.com/en/collections/%C3%A9?%C3%BC#%C3%9F"), ("1:b", "https://u:p@shop.example.com/en/collections/1:b"), ("//", None), ("https://", None),
]


def test_resolved(spark):
    got = run(spark, [(k, r, BASE) for k, (r, _) in enumerate(RESOLVED)], U.url_resolve(F.col("u"), F.col("b")), "u string, b string")
    assert [(r, g) for (r, _), g in zip(RESOLVED, got, strict=True)] == RESOLVED
    assert run(spark, [(0, "/a", "no address"), (1, "https://a.b", None)], U.url_resolve(F.col("u"), F.col("b")), "u string, b string") == [None, None]


@pytest.mark.parametrize("host,private", [("2130706433", True), ("127.1", True), ("0x7f000001", True), ("0xA.1.1.1", True), ("192.168.257", True), ("LOCALHOST", True), ("[::1]", True), ("::1", True), ("[0:0::1]", True), ("8.8.8.8", False), ("134744072", False), ("10.example.com", False), ("shop.example.com", False), ("１０.0.0.1", True)])
def test_number_forms_of_private_hosts(spark, host, private):
    assert run(spark, [(0, host)], U.url_is_private_host(F.col("u"))) == [private]


def test_operators_read_addresses_alike(spark):
    req = "https://shop.example.com/collections/hats?sort_by=best-selling"
    rows = [(k, req, loc) for k, loc in enumerate([r"/\evil.example.org/collections/hats", r"https://shop.example.com\@evil.example.org/collections/hats", "HTTPS://WWW.Shop.Example.com:443/collections/Hats", "/collections/caps", req])]
    got = run(spark, rows, U.safe_redirect_target(F.col("a"), F.col("b")), "a string, b string")
    assert got == [None, "https://shop.example.com/@evil.example.org/collections/hats?sort_by=best-selling", "https://www.shop.example.com/collections/Hats?sort_by=best-selling", None, None]
    odd = "HTTPS://Shop.Example.com:443/a/../Collections/H%C3%A4/?b=1&utm_source=x#f"
    one = lambda made: run(spark, [(0, odd)], made)[0]
    u = F.col("u")
    assert one(U.url_strip_tracking(u)) == "https://shop.example.com/Collections/H%C3%A4/?b=1"
    assert one(U.listing_key(u)) == "shop.example.com|/Collections/H%C3%A4"
    assert one(U.collection_handle(u)) == "h%c3%a4"
    assert tuple(one(U.url_validate(u))) == ("shop.example.com", None)
    assert one(U.feed_url(u)["feed"]) == "https://shop.example.com/Collections/H%C3%A4/products.json"
    assert one(U.paginated_url(u, F.lit(2))) == "https://shop.example.com/Collections/H%C3%A4/?b=1&utm_source=x&page=2"
    kinds = [("https://a.b:443/products/x.js", "js", None), ("https://a.b:444/products/x", None, "port"), (r"https:\\a.b\products\x", "page", None), ("https://u@a.b/products/x", None, "credentials"), ("http://a.b/products/x", None, "not_https"), ("nothing", None, "not_a_url"), ("https://a.b/x", None, "not_a_product_path")]
    assert [tuple(r) for r in run(spark, [(k, r) for k, (r, *_) in enumerate(kinds)], U.product_url_kind(u))] == [tuple(r) for _, *r in kinds]
