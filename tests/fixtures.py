"""Small literal tables in the shapes the engine works on."""
import datetime as dt

import numpy as np
import pandas as pd


def walk(spark, n=100, start="2024-01-02 09:30:00", base=17000.0, seed=42, symbol="AAA"):
    rng = np.random.default_rng(seed)
    close = base + rng.normal(0, 2, n).cumsum()
    open_ = close + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame({
        "symbol": symbol, "ts": pd.date_range(start, periods=n, freq="1min"), "open": open_, "high": np.maximum(open_, close) + rng.random(n), "low": np.minimum(open_, close) - rng.random(n),
        "close": close, "volume": rng.integers(10, 500, n).astype(float), "ingest_id": np.arange(n)})
    df = spark.createDataFrame(pdf)
    return pdf, df.withColumn("ts", df.ts.cast("timestamp_ntz"))


def t(text):
    return dt.datetime.fromisoformat(text)
