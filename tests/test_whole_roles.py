from __future__ import annotations

from lattica.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_every_supplier_and_customer_takes_part(spark):
    nations = {r.n_nationkey: r.n_name for r in table(spark, "nation")}
    suppliers = [(nations[r.s_nationkey], r.s_suppkey) for r in table(spark, "supplier")]
    customers = [(nations[r.c_nationkey], r.c_custkey) for r in table(spark, "customer")]
    for query, one, other in (("shared_key_declared", "write", "read"),):
        want = {(k, one, p, sum(c[0] == k for c in customers)) for k, p in suppliers} | {(k, other, p, sum(x[0] == k for x in suppliers)) for k, p in customers}
        got = [tuple(r) for r in QUERIES[query](spark, SF).collect()]
        assert set(got) == {w for w in want if w[3]} and len(got) == len(set(got))
