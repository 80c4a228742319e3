import datetime as dt
import random

from pitlake.llm import url_filter

D = dt.date


def plain(url, day, entries):
    """The most specific pattern's entry in force on the day."""
    if url is None or day is None or "://" not in url or not url.lower().startswith("http"):
        return None
    host, slash, rest = url.split("://", 1)[1].partition("/")
    path = "/" + rest.split("?")[0].split("#")[0]
    host = host.split("?")[0].split("#")[0].rpartition("@")[2].split(":")[0].lower().rstrip(".")
    parts = path.split("/")[1:-1]
    names = [host + "/" + "/".join(parts[:n]) + "/" for n in range(len(parts), 0, -1)] + [host + "/"]
    labels = host.split(".")
    names += [".".join(labels[n:]) for n in range(len(labels))]
    for name in names:
        dated = {}
        for p, v, at in entries:
            if p and v and at and p.lower() == name:
                dated.setdefault(at, []).append(v)
        active = [at for at in dated if at <= day]
        if active:
            at = max(active)
            return ("block" if "block" in dated[at] else min(dated[at])), name, at
    return None


def test_against_every_entry(spark):
    rng = random.Random(6)
    hosts = ["a.org", "x.a.org", "y.x.a.org", "b.net", "b.net:8080", "user@b.net", "B.NET.", "localhost"]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS", "ftp") for h in hosts for p in ("", "/", "/p", "/p/", "/p/q/r?z=/", "/p/q#f")] + [None, "", "a.org/p"]
    rows = [(i, rng.choice(urls), rng.choice([None, *[D(2024, 1, 1) + dt.timedelta(rng.randrange(200)) for _ in range(5)]]), "clash") for i in range(600)]
    patterns = ["a.org", "x.a.org", "org", "b.net", "b.net/p/", "a.org/p/q/", "x.a.org/p/", "A.org/", "localhost", None]
    entries = [(rng.choice(patterns), rng.choice(["block", "allow", "allow", None]), rng.choice([None, *[D(2023, 12, 1) + dt.timedelta(rng.randrange(230)) for _ in range(9)]])) for _ in range(60)]
    captures = spark.createDataFrame(rows + rows[:2], "page_id long, url string, fetched_at date, verdict string")
    got = url_filter.judge(captures, spark.createDataFrame(entries, "pattern string, verdict string, listed_at date")).collect()
    assert len(got) == 602
    for r in got:
        want = plain(r.url, r.fetched_at, entries)
        assert (None if r.verdict is None else (r.verdict, r.pattern, r.since)) == want, r
    assert any(r.verdict for r in got)


def test_empty(spark):
    captures = spark.createDataFrame([(1, "http://a.org/", D(2024, 1, 1))], "page_id long, url string, fetched_at date")
    none = spark.createDataFrame([], "pattern string, verdict string, listed_at date")
    assert [r.verdict for r in url_filter.judge(captures, none).collect()] == [None]
    assert url_filter.judge(captures.limit(0), none).count() == 0


def test_deep_hosts_and_paths_and_the_case_of_paths(spark):
    on = D(2024, 1, 1)
    want = {
        "https://a.b.c.d.e.f.g.example.org/": "example.org",
        "https://h.net/1/2/3/4/5/x": "h.net/1/2/3/4/",
        "https://h.net/1/2/3/4": None,
        "https://h.net/a/b/c/d/e/f/g/h/i/j/k/l/m": "h.net/a/b/c/d/e/f/g/h/i/j/k/l/",
        "https://Case.org/Blog/x": "case.org/Blog/",
        "https://case.org/blog/x": None,
        "https://p.l1.l2.l3.l4.l5.l6.l7.deep.net/": "l1.l2.l3.l4.l5.l6.l7.deep.net",
        "https://q.deep.net/": None,
    }
    names = ["example.org", "h.net/1/2/3/4/", "h.net/a/b/c/d/e/f/g/h/i/j/k/l/", "CASE.org/Blog/", "l1.l2.l3.l4.l5.l6.l7.deep.net"]
    entries = spark.createDataFrame([(n, "block", on) for n in names], "pattern string, verdict string, listed_at date")
    captures = spark.createDataFrame([(u, on) for u in [*want, *want]], "url string, fetched_at date")
    got = url_filter.judge(captures, entries).collect()
    assert len(got) == 2 * len(want)
    assert {r.url: r.pattern for r in got} == want


def test_single_labels(spark):
    on = D(2024, 1, 1)
    entries = spark.createDataFrame([("zip", "block", on), ("a.zip", "allow", D(2024, 2, 1))], "pattern string, verdict string, listed_at date")
    captures = spark.createDataFrame([("http://a.zip/x", on), ("http://a.zip/x", D(2024, 3, 1)), ("http://b.c.zip/", on), ("http://zip/", on), ("http://a.zip.org/", on)], "url string, fetched_at date")
    got = {(r.url, r.fetched_at): r.pattern for r in url_filter.judge(captures, entries).collect()}
    assert [got[r.url, r.fetched_at] for r in captures.collect()] == ["zip", "a.zip", "zip", "zip", None]


def test_odd_years(spark):
    days = [D(1, 1, 1), D(1999, 12, 31), D(2024, 2, 29), D(9999, 12, 31)]
    entries = spark.createDataFrame([("a.org", "block", D(2000, 1, 1)), ("a.org", "allow", D(2024, 3, 1))], "pattern string, verdict string, listed_at date")
    captures = spark.createDataFrame([("http://a.org/", d) for d in days], "url string, fetched_at date")
    assert [r.verdict for r in url_filter.judge(captures, entries).orderBy("fetched_at").collect()] == [None, None, "block", "allow"]
