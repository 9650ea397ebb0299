import random

import pytest

from mnemoframe.llm import url_filter
from mnemoframe.llm.queries import URL_RULES

URLS = [
    "http://www.example.com/en/1", "https://example.com/en/", "https://a.example.com/en/x?y", "x://com/",
    "https://EXAMPLE.net/es/1#a", "https://example.net/fr", "https://net/fr/", "https://notnet/fr/",
    "https://a.net:80/es/", "://", "none", "", None, "http:///path", "https://a.b.com", "https://com?x",
    "ftp://x.net/es/é/" + "y" * 100_000, "http://" + "a." * 20_000 + "net/fr/", "http://wwwexample.com/en/",
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, default))


@pytest.mark.parametrize("max_bytes", [url_filter.MAX_INDEX_BYTES, 0])
def test_index_and_join_agree_with_brute_force(spark, max_bytes):
    rng = random.Random(5)
    rules = [*URL_RULES, ("block", "a.net:80", "/es/"), ("block", "é.de", "/ü")]
    urls = [*URLS, *(f"https://{'.'.join(rng.choices(['www', 'example', 'a', 'net', 'com'], k=3))}"
                     f"/{rng.choice(['en', 'es', 'fr', ''])}/{i}" for i in range(200)), "https://x.é.de/ü1"]
    pages = spark.createDataFrame(
        [(i % 50, u, "x", "y") for i, u in enumerate(urls)],
        "page_id long, url string, host string, verdict string")
    given = spark.createDataFrame([*rules, rules[0]], url_filter.RULE_SCHEMA)
    found = url_filter.judge(pages, given, max_index_bytes=max_bytes).collect()
    want = [(i % 50, *brute(u, rules)) for i, u in enumerate(urls)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    assert url_filter.judge(pages, none).first()["verdict"] == "allow"
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(
        URL_RULES, url_filter.RULE_SCHEMA)).count() == 0


def test_equal_digests_are_told_apart_by_text():
    parts = url_filter.DigestArray.parts([("block", "a.com", "/"), ("allow", "b.com", "/")], ["allow", "block"])
    parts["digests"][:] = parts["digests"][0]  # as if both texts had one digest
    index = url_filter.DigestArray(**parts, names=["allow", "block"])
    texts = {index.text(0): 0, index.text(1): 1}
    import xxhash
    real = xxhash.xxh64_intdigest
    try:
        xxhash.xxh64_intdigest = lambda key, seed: int(parts["digests"][0])
        assert index.find([b"a.com/", b"b.com/", b"c.com/"], [5, 5, 5]).tolist() == [
            texts[b"a.com/"], texts[b"b.com/"], -1]
    finally:
        xxhash.xxh64_intdigest = real
