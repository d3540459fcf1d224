"""Rules as queries over tables made for a case, against their SQL."""

import oracle
import pandas as pd
from simloom.plans import rule_queries  # noqa: F401
from simloom.plans.catalog import QUERIES, SQL

FULL = "/root/testdata/sf0.001"


def orders_of(tmp_path, lines):
    """Tables of an order (its customer of nation 0) per list of supplier nations; supplier n is of nation n."""
    rows = [(o, n, i) for o, nations in enumerate(lines) for i, n in enumerate(nations)]
    made = {
        "customer": pd.DataFrame({"c_custkey": [0], "c_nationkey": [0]}),
        "supplier": pd.DataFrame({"s_suppkey": range(25), "s_nationkey": range(25)}),
        "orders": pd.DataFrame({"o_orderkey": range(len(lines)), "o_custkey": 0}),
        "lineitem": pd.DataFrame(rows, columns=["l_orderkey", "l_suppkey", "l_linenumber"]),
    }
    for name in oracle.TABLES:
        if name in made:
            made[name].to_parquet(tmp_path / f"{name}.parquet")
        else:
            (tmp_path / f"{name}.parquet").symlink_to(f"{FULL}/{name}.parquet")
    return str(tmp_path)


def test_envy_locality_halves(spark, tmp_path):
    """One of eight accesses is 0.125, an exact half."""
    sf = orders_of(tmp_path, [[0] + [3] * 7, [0, 0] + [4] * 14, [0] + [5] * 6, [6] * 5, [0] * 3 + [7, 8] * 4])
    assert oracle.compare(spark, oracle.connect(sf), QUERIES["q56_envy_rule"], SQL["q56_envy_rule"], sf) == 5
    assert "LDA=0.12," in QUERIES["q56_envy_rule"](spark, sf).where("line = 0").first().description
