import pytest

from corpusmill import catalog

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(name, spark):
    df = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.count() == len(df.collect()) > 0


def test_pagerank_converged_equals_brute_force(spark, tmp_path):
    """A chain with a cycle and a sink, which three rounds do not rank; link by link to the stated change."""
    links = sorted({(s, p % 97) for s, p in [*((i, i + 1) for i in range(1, 40)), (40, 1), (5, 60), (7, 60), (60, 61), (61, 60), (3, 90), (8, 3)]})
    spark.createDataFrame(links, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.node: r["rank"] for r in catalog.QUERIES["pagerank_converged"](spark, str(tmp_path)).collect()}
    names = sorted({x for link in links for x in link})
    out = {n: [d for s, d in links if s == n] for n in names}
    rank, rounds, change = dict.fromkeys(names, 1 / len(names)), 0, 1.0
    while change >= len(names) * 1e-6 and rounds < 100:
        new = dict.fromkeys(names, 0.15 / len(names) + 0.85 * sum(rank[n] for n in names if not out[n]) / len(names))
        for n in names:
            for d in out[n]:
                new[d] += 0.85 * rank[n] / len(out[n])
        change, rank, rounds = sum(abs(new[n] - rank[n]) for n in names), new, rounds + 1
    assert 3 < rounds < 100
    assert got.keys() == {f"s{n}" for n in names} and all(abs(got[f"s{n}"] - rank[n]) < 1e-8 for n in names)
    three = {r.node: r["rank"] for r in catalog.QUERIES["pagerank_fixed_iters"](spark, str(tmp_path)).collect()}
    assert sum(abs(got[n] - three[n]) for n in got) > 0.01


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
