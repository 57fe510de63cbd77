"""The command line on a small table."""

from sievestone.__main__ import main


def test_commands(spark, tmp_path, capsys):
    rows = [(i, float(i % 9), "a" if i % 2 else "b") for i in range(60)] + [(60, 0.0, "b"), (61, 900.0, "a")]
    spark.createDataFrame(rows, "k long, x double, y string").write.parquet(f"{tmp_path}/t.parquet")
    assert main(["analyze", f"{tmp_path}/t.parquet", "--key", "k", "--label", "y"]) == 0
    assert "overall" in capsys.readouterr().out
    assert main(["check", f"{tmp_path}/t.parquet", "--key", "k", "--least", "101"]) == 1
    assert main(["fix", f"{tmp_path}/t.parquet", "--key", "k", "--to", f"{tmp_path}/kept"]) == 0
    kept = {r.k for r in spark.read.parquet(f"{tmp_path}/kept").collect()}
    assert 61 not in kept and 60 not in kept and 0 in kept
    assert main(["ask", f"{tmp_path}/t.parquet", "--key", "k", "--question", "how many outliers?"]) == 0
