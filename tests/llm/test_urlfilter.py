from pyspark.sql import functions as F
from tests.conftest import SF

from lumenfold.llm import urlfilter
from lumenfold.llm.common import table

URLS = [
    ("http://a.example.com/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
    ("https://EXAMPLE.com/en/8", "example.com", "/en/8", "com/en/", "block"),
    ("x://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
    ("http://b.net/de/", "b.net", "/de/", "net/de/", "allow"),
    ("http://o.org/es/1://z", "o.org", "/es/1://z", "org/es/", "block"),
    ("http://o.org?x/es/", "o.org", "", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    for r in urlfilter.url_verdicts(df).collect():
        _, host, path, rule, verdict = URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])
    assert urlfilter.url_verdicts(df.where("false")).collect() == []
    only = urlfilter.url_verdicts(df.where("page_id in (1, 6)"))
    assert {r["verdict"] for r in only.collect()} == {"block"}


def test_every_column_comes_back(spark):
    """Names of the model's own columns, of the results and odd ones."""
    names = "features grams probability chars _says says label host path rule prediction rawPrediction _0 _1 a.b".split()
    df = spark.createDataFrame([(i, u[0], *(f"{n}{i}" for n in names)) for i, u in enumerate(URLS)], "page_id long, url string, " + ", ".join(f"`{n}` string" for n in names))
    out = urlfilter.url_verdicts(df)
    assert sorted(out.columns) == sorted({*df.columns, "host", "path", "rule", "verdict", "p_block"})
    for r in out.collect():
        assert all(r[n] == f"{n}{r['page_id']}" for n in names if n not in ("host", "path", "rule")) and r["host"] == URLS[r["page_id"]][1]


def test_verdicts_are_those_of_the_regression(spark):
    """The same features and weights by hand: Spark's hashing of trigrams, then a plain logistic regression by gradient steps."""
    import numpy as np
    from pyspark.ml.feature import HashingTF

    rng = np.random.default_rng(4)
    names = ["".join(rng.choice(list("abcdef"), 6)) for _ in range(40)]
    urls = [(f"http://{n}.{'biz/win' if i % 2 else 'info/story'}/{i}", i % 2) for i, n in enumerate(names)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r for r in urlfilter.url_verdicts(pages, rules=(), labelled=spark.createDataFrame(urls, "url string, block int")).collect()}
    tf, rows = HashingTF(numFeatures=urlfilter.FEATURES, binary=True), []
    for i in range(len(urls)):
        x = list(f"^{got[i]['host']} {got[i]['path']}$")
        rows.append(sorted({tf.indexOf(" ".join(x[j : j + 3])) for j in range(len(x) - 2)}))
    used = sorted({k for r in rows for k in r})
    x = np.zeros((len(rows), len(used)))
    for i, r in enumerate(rows):
        x[i, np.searchsorted(used, r)] = 1
    y = np.array([b for _, b in urls], float)
    scale = x.std(0, ddof=1)
    z, w, b = x / np.where(scale > 0, scale, 1) * (scale > 0), np.zeros(len(used)), 0.0
    for _ in range(4000):
        d = 1 / (1 + np.exp(-(z @ w + b))) - y
        w -= 0.05 * (z.T @ d / len(y) + 0.002 * w)
        b -= 0.05 * d.mean()
    p = 1 / (1 + np.exp(-(z @ w + b)))
    assert np.abs(p - [got[i]["p_block"] for i in range(len(urls))]).max() < 0.02
    assert all(got[i]["verdict"] == ("block" if p[i] >= 0.5 else "allow") for i in range(len(urls)))


def test_learns_from_a_labelled_table(spark):
    labelled = spark.createDataFrame([(f"http://spam{i}.biz/win/{i}", 1) for i in range(30)] + [(f"http://news{i}.info/story/{i}", 0) for i in range(30)], "url string, block int")
    pages = spark.createDataFrame([(1, "http://spam99.biz/win/5"), (2, "http://news77.info/story/8")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.url_verdicts(pages, rules=(), labelled=labelled).collect()}
    assert got == {1: "block", 2: "allow"}


def test_agrees_with_the_rules_that_it_learned_from(spark):
    scored = urlfilter.url_verdicts(table(spark, SF, "pages")).where("rule is not null").selectExpr("avg(cast((p_block >= 0.5) = (verdict = 'block') as int)) a").first()
    assert scored["a"] > 0.9


def test_repeated_urls_teach_once(spark):
    """More copies of one url than may train change nothing for the others, whether a rule or a given table labels it."""
    pages = table(spark, SF, "pages").select("page_id", "url")
    blocked = pages.join(urlfilter.url_verdicts(pages).where("rule is not null and verdict = 'block'").select("page_id"), "page_id").first()["url"]
    copies = spark.range(5000).select((F.col("id") + 1_000_000).alias("page_id"), F.lit(blocked).alias("url"))
    say = lambda df: {r["page_id"]: (r["verdict"], r["p_block"]) for r in df.where("page_id < 1000000").collect()}
    assert say(urlfilter.url_verdicts(pages.unionByName(copies))) == say(urlfilter.url_verdicts(pages))
    given = spark.createDataFrame([(f"http://spam{i}.biz/win/{i}", 1) for i in range(30)] + [(f"http://news{i}.info/story/{i}", 0) for i in range(30)], "url string, block int")
    more = given.unionByName(spark.range(5000).select(F.lit("http://spam3.biz/win/3").alias("url"), F.lit(1).alias("block")))
    assert say(urlfilter.url_verdicts(pages, rules=(), labelled=more)) == say(urlfilter.url_verdicts(pages, rules=(), labelled=given))


def test_no_class_crowds_out_the_other(spark):
    given = [(f"http://spam{i}.biz/win/{i}", 1) for i in range(400)] + [(f"http://news{i}.info/story/{i}", 0) for i in range(5)]
    labelled = spark.createDataFrame(given, "url string, block int")
    pages = spark.createDataFrame([(1, "http://spam999.biz/win/5"), (2, "http://news77.info/story/8")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.url_verdicts(pages, rules=(), labelled=labelled, max_labelled=12).collect()}
    assert got == {1: "block", 2: "allow"}
