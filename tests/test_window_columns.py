from barloom.operators import exits


def test_windows_hold_the_columns_asked_for(spark):
    b = spark.range(1, 600).selectExpr("'A' AS symbol", "id AS ord", "timestamp_ntz '2024-03-05' AS ts", *[f"id * 1.0D AS {c}" for c in ("open", "high", "low", "close")])
    t = spark.createDataFrame([(1, "A", 40, 560)], "trade_id long, symbol string, entry_ord long, exit_ord long")
    (row,) = exits.trade_windows(t, b, 10, columns=["close"]).collect()
    assert row.window[0].asDict() == {"ord": 30, "close": 30.0} and [x.ord for x in row.window] == list(range(30, 571))
