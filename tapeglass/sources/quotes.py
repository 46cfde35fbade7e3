"""Daily prices from any source, a ticker at a time, in parallel tasks."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schemas import OHLCV

#: (ticker, start, end) -> rows of (date, open, high, low, close, volume).
PriceSource = Callable[[str, str, str], list[tuple]]
FIELDS = ("date", "Open", "High", "Low", "Close", "Volume")


def download(spark: SparkSession, source: PriceSource, tickers: list[str], start: str, end: str, retries: int = 3, pause: float = 0.0) -> DataFrame:
    """OHLCV rows, by date within a ticker; a ticker that fails ``retries`` times has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ticker in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for _ in range(retries):
                    try:
                        rows = sorted(source(ticker, start, end))
                        break
                    except Exception:  # any failure of a remote source is tried again
                        time.sleep(pause)
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                dates = [d.date() if isinstance(d, dt.datetime) else d for d in cols[0]]
                yield pa.RecordBatch.from_arrays([pa.array([ticker] * len(rows), pa.string()), pa.array(dates, pa.date32()), *(pa.array([None if v is None else float(v) for v in c], pa.float64()) for c in cols[1:])], names=["ticker", *FIELDS])

    names = spark.createDataFrame([(t,) for t in tickers], "ticker string").repartition(max(1, min(len(tickers), 64)))
    return names.mapInArrow(run, OHLCV)


def instruments(spark: SparkSession, path: str) -> DataFrame:
    """The instrument dictionary (ticker, company, sector, keywords, cap_tier) from a JSON-lines or Parquet file."""
    from ..schemas import INSTRUMENTS

    reader = spark.read.schema(INSTRUMENTS)
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)


def file_name(ticker: str) -> str:
    """A ticker as a file name: an index's caret is spelled out."""
    return ticker.replace("^", "IDX_") + ".parquet"
