import random

from llm_helpers import rows

from ripplegraph.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, host string, rule int"
URLS = ["http://a.example.org/es/x", "https://example.org/en/12", "https://example.org/en/2", "x://EXAMPLE.ORG/es/", "http://notexample.org/es/1", "http://b.com/de/1", "http://b.com/fr/", "http://b.com/", "http://com/de/", "nothing", None, "", "://", "http://é.com/de/ü?q#f", "http://h.org?x=/y", "http://h.org#/y", "http://h.org/a?b=://c/d", "http://h.org", "a b://u:p@h.org:80/es/", "http://I.İ.org/", "http://" + "a." * 300 + "org/" + "p" * 5000, "http://h.org/a://b"]


def frame(spark, urls=URLS):
    return spark.createDataFrame([(i, u, "h", "x", 1) for i, u in enumerate(urls)], SCHEMA)


def test_query_equals_sql(spark, write, sql):
    path = write(pages=frame(spark, URLS + URLS[:3]))
    assert rows(U.op10_url_filter(spark, path)) == sql(U.ORACLE)
    assert U.op10_url_filter(spark, write(pages=frame(spark, []))).count() == 0


def test_array_against_all_rules(tmp_path):
    rnd = random.Random(1)
    part = lambda: rnd.choice("abc") * rnd.randrange(1, 3)
    rules = [(rnd.choice(U.VERDICTS), ".".join(part() for _ in range(rnd.randrange(1, 4))), "/" + "/".join(part() for _ in range(rnd.randrange(3)))) for _ in range(400)]
    U.write_array(rules, str(tmp_path / "a"))
    array = U.DigestArray(str(tmp_path / "a"))
    assert (array.keys[1:] >= array.keys[:-1]).all()
    held = {h + p: (v, h, p) for v, h, p in rules}
    for _ in range(500):
        host, path = ".".join(part() for _ in range(rnd.randrange(1, 5))), "/" + "/".join(part() for _ in range(rnd.randrange(4)))
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in held.values() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        j = array.judge([host], [path])[0]
        if not fits:
            assert j == -1
        else:
            assert (array.string(j).decode(), U.VERDICTS[array.verdicts[j]]) == max(fits)[2:]


def test_colliding_keys_are_told_apart(tmp_path, monkeypatch):
    real = U.xxhash.xxh64_intdigest
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda s: real(s) & 3)
    rules = [("block", f"h{i}.com", "/") for i in range(30)]
    U.write_array(rules, str(tmp_path / "a"))
    array = U.DigestArray(str(tmp_path / "a"))
    for i in range(30):
        assert array.string(array.judge([f"h{i}.com"], ["/x"])[0]) == f"h{i}.com/".encode()
    assert array.judge(["h99.com"], ["/x"]) == [-1]


def test_a_host_of_a_megabyte(tmp_path):
    U.write_array(U.RULES, str(tmp_path / "a"))
    array = U.DigestArray(str(tmp_path / "a"))
    hosts = ["a." * 500_000 + h for h in ("example.org", "com", "xcom", "net")] + ["x" * 1_000_000, "." * 1_000_000 + "org", ".org", "xample.org"]
    told = [array.string(j).decode() if j >= 0 else None for j in array.judge(hosts, ["/de/"] * len(hosts))]
    assert told == ["org/", "com/de/", None, None, None, "org/", "org/", "org/"]


def test_empty_list(tmp_path):
    U.write_array([], str(tmp_path / "a"))
    assert U.DigestArray(str(tmp_path / "a")).judge(["a.b"], ["/"]) == [-1]
