import random

from helpers import EXTRA
from pyspark.sql import functions as F

from weekrank.llm import url_filters as U

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
         ("b.example.org/es/x", "allow"), ("twice.com/", "allow"), ("twice.com/", "block"), (None, "block"), ("nopath", "block")]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for rule, verdict in RULES:
        if rule and "/" in rule:
            h, p = rule[:rule.index("/")], rule[rule.index("/"):]
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
                best = (rule, verdict)
    verdict = "allow" if best is None else "block" if any(r == best[0] and v == "block" for r, v in RULES) else "allow"
    return host, path, best and best[0], verdict


def urls():
    rng = random.Random(3)
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "b.example.org", "xexample.org", "org", ".org", "x.com", "twice.com", "Éx.NET", "", "a..org"]
    paths = ["", "/", "/es/", "/es/x/1", "/es", "/en/1", "/en/12", "/fr/a", "/de/b?c=/fr/", "/de#x", "?q=/es/", "/fr/ünï"]
    out = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    return out + [None, "", "no scheme", "a://b://c/d", "x://" + "a." * 3000 + "org/" + "y" * 5000, "http://x\ny.org/a\nb"]


def judged(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in [*EXTRA, "host", "path", "rule", "verdict", "one"]})
    out = U.judge(df.repartition(4), U.rule_table(spark, RULES))
    return sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()], key=repr)


def test_against_brute_force(spark):
    rows = list(enumerate(urls())) + [(None, "http://example.org/es/"), (0, urls()[0])]
    assert judged(spark, rows) == sorted([(i, *brute(u)) for i, u in rows], key=repr)


def test_empty_tables(spark):
    assert judged(spark, []) == []
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rows = U.judge(pages, U.rule_table(spark, RULES).limit(0)).collect()
    assert [(r.host, r.rule, r.verdict) for r in rows] == [("a.org", None, "allow")]


def test_cascade_is_exact_over_the_universe(spark):
    """Thousands of keys, a loose first level: several levels are needed, and every key is told right."""
    universe = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.filter("key rlike '7$'").unionByName(spark.createDataFrame([(None,), ("outside",)], "key string"))
    cascade = U.build(listed, universe, rate=0.2)
    assert len(cascade.levels) > 2 and cascade.bytes < 10_000
    wrong = universe.filter(cascade.contains(F.col("key")) != F.col("key").rlike("7$"))
    assert wrong.count() == 0
    assert not spark.createDataFrame([(None,)], "key string").select(cascade.contains(F.col("key"))).first()[0]


def test_empty_list(spark):
    universe = spark.range(5).select(F.col("id").cast("string").alias("key"))
    cascade = U.build(universe.limit(0), universe)
    assert universe.filter(cascade.contains(F.col("key"))).count() == 0
