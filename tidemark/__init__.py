"""Spark-first toolkit for gappy time series, forecast evaluation and corpus preparation."""
