import hashlib

from bankflow.operators.locations import assign_city, city_list
from tests.helpers import rows

CITIES = ["Ambon", "Aceh", "Bandung", "Solo", "Medan", "Surabaya", "Élan", "bogor"]


def make(spark, cities):
    customers = spark.createDataFrame(
        [(f"c{i}", c) for i, c in enumerate(cities)] + [("cx", ""), ("cn", None)],
        "customer_id string, city string",
    )
    accounts = spark.createDataFrame(
        [(f"a{i}", f"c{i}") for i in range(len(cities))]
        + [("ax", "cx"), ("an", "cn"), ("ay", "unknown")],
        "account_id string, customer_id string",
    )
    known = [f"a{i}" for i in range(len(cities))]
    owners = known + ["ax", "an", "ay", "missing"]
    data = [
        (f"TXN{i:05d}", owners[i % len(owners)], "Groceries" if i % 5 else (None if i % 2 else ""))
        for i in range(600)
    ]
    txns = spark.createDataFrame(
        data, "txn_id string, account_id string, merchant_category string"
    )
    home = {f"a{i}": c for i, c in enumerate(cities)}
    return customers, accounts, txns, data, home


def expected(data, home, cities, share):
    ordered = sorted(set(cities))
    result = []
    for txn_id, account, category in data:
        if not category or account not in home:
            continue
        number = int(hashlib.md5(txn_id.encode()).hexdigest()[:8], 16)
        city, others = home[account], [c for c in ordered if c != home[account]]
        if number % 100 >= share and others:
            city = others[(number // 100) % len(others)]
        result.append((txn_id, city, "SYNTHETIC_TEST"))
    return sorted(result, key=repr)


def test_city_choice_matches_brute_force(spark):
    customers, accounts, txns, data, home = make(spark, CITIES + ["Solo"])
    for share in (95, 30, 0, 100):
        got = rows(assign_city(txns, accounts, customers, home_share=share))
        assert got == expected(data, home, CITIES, share)


def test_one_city_stays_home(spark):
    customers, accounts, txns, data, home = make(spark, ["Solo", "Solo"])
    got = rows(assign_city(txns, accounts, customers, home_share=0))
    assert got == expected(data, home, ["Solo"], 0) and got


def test_city_positions(spark):
    customers, *_ = make(spark, CITIES)
    got = dict(city_list(customers).collect())
    assert got == {c: i for i, c in enumerate(sorted(CITIES))}
