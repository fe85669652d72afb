"""Mixing, URL filters and chats: SQL's rows, and defined results for odd rows."""

from pyspark.sql import functions as F

from vellumine.llm import chat, mixing, urls

DOCS = "doc_id long, text string, source string, extra string"


def test_same_rows_as_sql(same):
    same(mixing.op7, mixing.sql())
    same(urls.op9, urls.sql())
    same(chat.op6, chat.sql())


def rows_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_mixing_odd_rows(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (3, "one two", "a", "x"), (3, "one two", "a", "x"), (None, "w " * 50, None, "x"), (5, "w " * 5000, "b", None), (6, "\t\n", "c", "x")]
    got = mixing.mix(rows_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["source"]): r for r in got}
    assert by[1, "a"]["size"] == 0 and by[5, "b"]["size"] == 5000 and by[None, None]["size"] == 50 and by[6, "c"]["target"] == 0.0
    whole = sum(r["size"] for r in got)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - whole) < 1e-6
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(rows_of(spark, [])).count() == 0


def test_mixing_comes_near_its_targets(spark, sf):
    got = mixing.op7(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    per = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("longest")).collect()
    assert all(abs(r["taken"] - r["target"]) <= r["longest"] for r in per)
    again = mixing.op7(spark, "/root/testdata/sf0.01")
    assert again.exceptAll(mixing.op7(spark, "/root/testdata/sf0.01")).count() == 0


def test_hot_buckets_are_salted_without_change(spark):
    rows = [(k, "same text here", "a" if k % 3 else "b", None) for k in range(300)]
    whole = mixing.mix(rows_of(spark, rows)).groupBy("source").agg(F.sum("taken")).collect()
    salted = mixing.mix(rows_of(spark, rows), rows_per_bucket=20).groupBy("source").agg(F.sum("taken")).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, salted))


def test_null_ids_are_salted_and_reruns_agree(spark, duck):
    rows = [(None if k % 2 else k // 4, f"same size {k % 50}", "a", str(k)) for k in range(300)]
    df = rows_of(spark, rows)
    once, again = (sorted(map(tuple, mixing.mix(df.repartition(n), rows_per_bucket=20, carry=("text", "extra")).collect()), key=str) for n in (3, 7))
    assert once == again and len(once) == 300
    duck.register("odd_rows", df.toArrow())
    want = duck.sql(mixing.sql("odd_rows", 20)).select("size", "taken").fetchall()
    got = mixing.mix(df, rows_per_bucket=20).select("doc_id", "size", "source_size", "target", "taken", "copies").collect()
    assert sorted(want) == sorted((r["size"], r["taken"]) for r in got)


def test_emitted_copies(spark):
    rows = [(k, "w " * (k + 1), "a" if k % 2 else "b", "x") for k in range(40)]
    mixed = mixing.mix(rows_of(spark, rows), carry=("text", "extra"))
    assert mixing.emitted(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_water_filling_stops_and_shares_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # weights 5, 2, 1, 5: a stops at 30, d at 0, the rest is shared 2 to 1
    assert got["a"] == 30.0 and got["d"] == 0.0 and abs(got["b"] - 1980 * 2 / 3) < 1e-9 and abs(got["c"] - 1980 / 3) < 1e-9


def test_url_parts_and_rules(spark):
    cases = [
        ("http://A.Example.COM/en/700?x#y", "a.example.com", "/en/700", "example.com/en/7", "allow"), ("https://b.org/es/", "b.org", "/es/", "org/es/", "block"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("x://h", "h", "", None, "allow"), ("x://net/de/1", "net", "/de/1", "net/de/", "block"), ("x://notnet/de/1", "notnet", "/de/1", None, "allow"), ("x://a?b://c/d", "a", "", None, "allow"), ("x://h/p#f?q", "h", "/p", None, "allow"),
    ]
    df = spark.createDataFrame([(k, u, "clash") for k, (u, *_) in enumerate(cases)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        if rule:
            assert got[k]["verdict"] == verdict
    assert urls.judge(df.limit(0)).count() == 0


def test_registered_domains_and_suffixes(spark):
    cases = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "www.x.org": ("x.org", "org"), "x.org": ("x.org", "org"), "localhost": ("localhost", "localhost"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "u:p@a.x.org:8080": ("x.org", "org"), "a.x.org.": ("x.org", "org"), "": (None, None), "[::1]:80": ("[::1]", "[::1]")}
    df = spark.createDataFrame([(h,) for h in cases], "h string").select("h", *urls.domains(urls.bare_host(F.col("h")))).collect()
    assert {r[0]: (r[1], r[2]) for r in df} == cases


def reputations(rows, rules):
    """Lower bounds by host, step by step."""
    def strength(level):
        some = [(b, n, p) for b, n, p in level if n > 1]
        more = sum((n - 1) * p * (1 - p) for _, n, p in some)
        if not more:
            return urls.STRENGTH
        over = sum(n * (b / n - p) ** 2 - p * (1 - p) for b, n, p in some)
        return 1 / max(0.001, min(0.999, over / more)) - 1

    hosts, domains, suffixes = ({}, {}, {})
    for host, path in rows:
        own, top = ".".join(host.split(".")[-2:]), host.split(".")[-1]
        fit = max((r for r in rules if (host == r[1].split("/")[0] or host.endswith("." + r[1].split("/")[0])) and path.startswith("/" + r[1].partition("/")[2])), key=lambda r: len(r[1]), default=None)
        for table, key in ((hosts, (host, own)), (domains, (own, top)), (suffixes, top)):
            b, n = table.get(key, (0, 0))
            table[key] = (b + (fit is not None and fit[0] == "block"), n + (fit is not None))
    bad, n = (sum(x[k] for x in suffixes.values()) for k in (0, 1))
    p_all = bad / n if n else 0.0
    m = strength([(b, n, p_all) for b, n in suffixes.values()])
    p_suffix = {k: (b + m * p_all) / (n + m) for k, (b, n) in suffixes.items()}
    m = strength([(b, n, p_suffix[top]) for (_, top), (b, n) in domains.items()])
    p_domain = {own: (b + m * p_suffix[top]) / (n + m) for (own, top), (b, n) in domains.items()}
    m = strength([(b, n, p_domain[own]) for (_, own), (b, n) in hosts.items()])
    out = {}
    for (host, own), (b, n) in hosts.items():
        x, y = b + m * p_domain[own], n - b + m * (1 - p_domain[own])
        out[host] = x / (x + y) - urls.DEVIATIONS * (x * y / (x + y) ** 2 / (x + y + 1)) ** 0.5
    return out


def test_reputations_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(f"{rng.choice('abc')}.{rng.choice(['p', 'q', 'r'])}.{rng.choice(['com', 'net', 'org'])}", f"/{rng.choice(['en', 'de', 'es', 'fr'])}/{k}") for k in range(600)]
    got = {r["host"]: r["reputation"] for r in urls.judge(spark.createDataFrame([(k, f"http://{h}{p}") for k, (h, p) in enumerate(rows)], "page_id long, url string")).collect()}
    want = reputations(rows, urls.RULES)
    assert set(got) == set(want) and all(abs(got[h] - want[h]) < 1e-9 for h in want)


def test_hot_hosts_are_judged_alike(spark, monkeypatch):
    rows = [(k, f"http://{'hot' if k % 3 else f'h{k % 7}'}.x.com/{'en' if k % 2 else 'fr'}/{k}") for k in range(300)] + [(1000 + k, None) for k in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    plain = sorted(map(str, urls.judge(df).collect()))
    monkeypatch.setattr("vellumine.llm.skew.HOT", 10)
    assert sorted(map(str, urls.judge(df).collect())) == plain


def test_bad_hosts_are_blocked_and_thin_evidence_is_not(spark):
    rows = [(k, f"http://bad.test.com/en/{k}", None) for k in range(50)] + [(100, "http://bad.test.com/other", None), (101, "http://new.other.io/x", None)] + [(200 + k, f"http://good.example.com/en/7{k}", None) for k in range(50)] + [(300, "http://good.example.com/x", None)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[100] == "block" and got[101] == "allow" and got[300] == "allow"
