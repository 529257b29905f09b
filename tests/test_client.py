import io

from tidemark import report
from tidemark.client import Client, commands
from tidemark.operators.relational import semi_reduction, hash_join
from tidemark.sources.modes import Mode, Scans
from tidemark.sources.tables import table


def test_commands_may_span_lines():
    assert list(commands(io.StringIO("sql select\n1; quit;\nrest"))) == ["sql select\n1", " quit"]


def test_client(spark, sf_dir, tmp_path):
    c = Client(spark, sf_dir)
    (tmp_path / "q.sql").write_text('SELECT COUNT(*) AS "n" FROM region;')
    assert "1 columns, 1 rows" in c.run(f"file {tmp_path}/q.sql")
    before = c.run("sql SELECT r_name FROM region ORDER BY r_name").splitlines()[:-1]
    for mode in ("caching-only", "hybrid", "pullup", "pushdown-only"):
        assert c.run(f"set mode {mode}") == f"mode {mode}"
        assert c.run("sql SELECT r_name FROM region ORDER BY r_name").splitlines()[:-1] == before
    assert "say \"hi\"" in c.run("""sql SELECT 'say "hi"' AS "a b" """) and "a b" in c.run("""sql SELECT 1 AS "a b" """)
    assert "Scan parquet" in c.run("explain SELECT r_name FROM region") and c.run("what") == "no command 'what'"
    assert c.run("quit") is None


def test_reports(spark, sf_dir):
    df = table(spark, sf_dir, "nation").groupBy("n_regionkey").count()
    assert report.graph(df).startswith("digraph plan {") and "HashAggregate" in report.graph(df)
    got = report.metrics(df)
    assert got["query"]["rows"] == 5 and any("numOutputRows" in m for m in got.values())


def test_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    with Scans(Mode.HYBRID, {"orders": ("o_orderkey",)}) as scans:
        scans.keep("orders", o, ["o_totalprice"])
        got = report.summary(scans.scan("orders", o, ["o_totalprice"], o.o_totalprice > 250_000), scans)
        assert got["rows_from_memory"] == o.count() and got["segment_hits"] == 1 and got["hit_rate"] == 1 and 0 < got["bytes_kept"] <= got["bytes_allowed"]
    got = report.summary(o.where("o_totalprice > 250000").select("o_orderkey"))
    assert got["rows_read"] == o.count() and got["bytes_read"] > 0 and got["selectivity"] == got["rows"] / o.count()


def test_reduction_changes_nothing(spark, sf_dir):
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size = 3")
    plain = hash_join(li, part, [("l_partkey", "p_partkey")]).count()
    assert hash_join(semi_reduction(li, part, [("l_partkey", "p_partkey")]), part, [("l_partkey", "p_partkey")]).count() == plain > 0
