"""Fuzzy joins against all pairs."""

import random
from difflib import SequenceMatcher

from seawake.operators import fuzzy
from seawake.plans import kpi, retrieval
from seawake.sources import bindings as B

SF = "/root/testdata/sf0.001"


def names(rng, n):
    base = ["gothenburg", "goteborg", "saint petersburg", "st. petersburg", "riga", "ria", "a", "ab", "axb", "", "kotka", "kotkaa", "aaaa", "aaaaa", "Ünïcödé", "port 12", "port 21", "x" * 300, "x" * 290 + "y" * 10]
    out = []
    for _ in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(s))
            s[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "o"])
        out.append("".join(s))
    return [*base, *out, None]


def one_column(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string").repartition(3)


def test_alike_and_contained_equal_all_pairs(spark):
    rng = random.Random(2)
    left, right = names(rng, 80), names(rng, 80)
    a, b = one_column(spark, left, "a"), one_column(spark, right, "b")
    pairs = [(x, y) for x in {*left} - {None} for y in {*right} - {None}]
    for least in (0.67, 0.8, 0.95, 1.0):
        want = {(x, y): r for x, y in pairs if (r := SequenceMatcher(None, x, y).ratio()) >= least}
        assert {(r.a, r.b): r.ratio for r in fuzzy.alike(a, b, least).collect()} == want
    assert {(r.a, r.b) for r in fuzzy.contained(a, b).collect()} == {(x, y) for x, y in pairs if x and y and (x in y or y in x)}


def brute(asked, catalog, least=0.80):
    """Every name with every port."""
    out = {}
    for a in asked:
        p, best = retrieval.plain(a), None
        for key, label, total in catalog:
            name = retrieval.plain(label)
            ratio = SequenceMatcher(None, p, name).ratio()
            tier = 0 if key == a.strip().upper() else 1 if name == p else 2 if p and name and (p in name or name in p) else 3 if ratio >= least else None
            if tier is not None:
                rank = (tier, -ratio if tier == 3 else 0.0, -total, key)
                best = min(best or rank, rank)
        out[a] = best and best[3]
    return out


def test_ports_equal_all_pairs_over_customers(spark):
    catalog = kpi.port_catalog(kpi.call_arrivals(B.calls(spark, SF)))
    ports = [(r.port_key, r.port_label, r.arrivals_total) for r in catalog.collect()]
    customers = [r.c_name for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_name").collect()]
    asked = [*customers[:150], "Port of NATION_3", "natión_4", " nation_5 ", "NATON_6", "NATIONN_7", "nation", "n", "zzz"]
    named = [(f"C{i}", n.replace("0", "")[2:], i) for i, n in enumerate(customers[:40])]  # customers' names as ports, too
    both = spark.createDataFrame([*ports, *named], "port_key string, port_label string, arrivals_total long")
    got = {r.asked: r.port_key for r in retrieval.resolve_ports(one_column(spark, asked, "asked"), both).collect()}
    assert got == brute(asked, [*ports, *named])


def test_query_equals_all_pairs(spark):
    from seawake.queries import QUERIES

    rows = QUERIES["fuzzy_ports"](spark, SF).collect()
    ports = [(r.port_key, r.port_label, r.arrivals_total) for r in kpi.port_catalog(kpi.call_arrivals(B.calls(spark, SF))).collect()]
    want = brute({r.asked for r in rows}, ports)
    assert len(rows) == spark.read.parquet(f"{SF}/customer.parquet").count() and all(r.port_key == want[r.asked] for r in rows)
