import numpy as np
import pandas as pd

from tidebar import __main__ as cli


def test_commands(spark, tmp_path, capsys):
    c = 100 * np.cumprod(1 + np.random.RandomState(1).normal(0, 0.02, 120))
    df = pd.DataFrame({"Symbol": "T", "Date": pd.date_range("2024-01-01", periods=120), "Close": c})
    spark.createDataFrame(df).write.parquet(str(tmp_path / "bars"))
    cli.main(["list"])
    assert "goldenCross" in capsys.readouterr().out
    cli.main(["compare", str(tmp_path / "bars"), "--strategy", "buyAndHold", "--strategy", "goldenCross", "--cash", "1억", "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    cli.main(["optimize", str(tmp_path / "bars"), "--param", "fast=3:5", "--param", "slow=10,20", "--out", str(tmp_path / "best")])
    assert spark.read.parquet(str(tmp_path / "best")).count() == 6
    assert cli.domain("0.1:0.3:0.1") == [0.1, 0.2, 0.3]
