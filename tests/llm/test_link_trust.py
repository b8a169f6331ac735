"""Rules and propagation over a small graph."""

import duckdb

from proofweave.llm import link_trust as L

SCHEMA = "page_id long, url string, html string"


def link(*hosts):
    return "".join(f'<a href="https://{h}/x">y</a>' for h in hosts)


PAGES = [
    (1, "https://good.org/a", link("friend.net", "GOOD.org", "friend.net")),
    (2, "http://bad.example.org/es/q?x=1", None),
    (3, "http://fan.net/", link("bad.example.org")),
    (4, "http://friend.net#top", link("cousin.net")),
    (5, "http://cousin.net", ""),
    (6, None, link("bad.example.org")),
    (7, "no address", None),
    (8, "HTTPS://A.Example.ORG/en/17", None),
    (9, "x://b.com/de/1", None),
    (10, "x://b.com/fr/1://c", None),
    (11, "x://com?q=/fr/", None),
    (12, "x://xcom/fr/", None),
    (13, "http://fan.net/", link("bad.example.org")),
    (13, "http://fan.net/", link("bad.example.org")),
]


def test_rules_and_flow(spark):
    frame = spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "1 as host", "2 as n", "3 as trust")
    got = {r["page_id"]: r for r in L.verdicts(frame).collect()}
    rules = {i: r["rule"] for i, r in got.items()}
    assert rules == {
        1: "org/", 2: "example.org/es/", 3: None, 4: None, 5: None, 6: None, 7: None, 8: "example.org/en/1",
        9: "com/de/", 10: "com/fr/", 11: None, 12: None, 13: None,
    }
    assert {i for i, r in got.items() if r["verdict"] == "block"} == {2, 3, 8, 9, 13}
    assert got[5]["trust"] > 0 and got[3]["distrust"] > 0 and got[5]["distrust"] == 0
    assert (got[10]["host"], got[10]["path"]) == ("b.com", "/fr/1://c")
    assert (got[11]["host"], got[11]["path"]) == ("com", "") and got[7]["host"] == ""


def test_same_as_sql(spark):
    import pandas as pd

    deep = [(100 + i, f"http://h{i}.net/", link(f"h{i + 1}.net")) for i in range(14)]
    deep += [(114, "http://h14.net/", '<A HREF\t= \'//bad.example.org\'> <a href = ftp+ssh.x-1://t.org>')]
    deep += [(115, "http://t.org/", link("u.net", "v.net")), (116, "http://u.net/", link("h3.net")), (117, "http://v.net", None)]
    pages = pd.DataFrame(PAGES + deep, columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.execute(L.oracle_sql()).fetchall()
    got = L.verdicts(spark.createDataFrame(PAGES + deep, SCHEMA)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r["verdict"] for r in got if 100 <= r["page_id"] < 115} == {"block", "allow"}


def test_ranks_match_a_matrix(spark):
    import numpy as np

    edges = [("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 1.0), ("c", "a", 1.0)]
    back = {("a", "b"): 1.0, ("a", "c"): 0.5, ("b", "c"): 0.5, ("c", "a"): 1.0}
    frame = spark.createDataFrame([(s, d, w, back[s, d]) for s, d, w in edges], "src string, dst string, out_share double, in_share double")
    seeds = spark.createDataFrame([("a", 3.0, 0.0), ("c", 1.0, 2.0)], "host string, trust double, distrust double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in L.propagate(frame, seeds, 10).collect()}
    m, n, at = np.zeros((3, 3)), np.zeros((3, 3)), "abc"
    for s, d, w in edges:
        m[at.index(d), at.index(s)], n[at.index(s), at.index(d)] = w, back[s, d]
    t, d = np.array([0.75, 0, 0.25]), np.array([0, 0, 1.0])
    t0, d0 = t, d
    for _ in range(10):
        t, d = 0.85 * m @ t + 0.15 * t0, 0.85 * n @ d + 0.15 * d0
    for i, h in enumerate(at):
        assert np.allclose(got[h], (t[i], d[i]))


def test_no_rows(spark):
    assert L.verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distrust_and_trust_reach_far_hosts(spark):
    chain = [(i, f"http://h{i}.net/", link(f"h{i + 1}.net")) for i in range(14)]
    chain.append((14, "http://h14.net/", link("bad.example.org")))
    chain.append((50, "http://bad.example.org/es/", None))
    chain.append((51, "http://aside.net/", '<a href="//h14.net">y</a>'))
    got = {r["page_id"]: r for r in L.verdicts(spark.createDataFrame(chain, SCHEMA)).collect()}
    assert {r["verdict"] for r in got.values()} == {"block"} and all(r["distrust"] > 0 for r in got.values())


def test_ranks_settle(spark):
    import numpy as np

    edges = [("a", "b", 1.0, 1.0), ("b", "a", 1.0, 1.0)]
    frame = spark.createDataFrame(edges, "src string, dst string, out_share double, in_share double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r["host"]: r["trust"] for r in L.propagate(frame, seeds, None, 0.3).collect()}
    assert np.allclose([got["a"], got["b"]], np.linalg.solve([[1, -0.3], [-0.3, 1]], [0.7, 0]), rtol=1e-11)
