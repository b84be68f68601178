"""measurekit: turn raw sensor events into traceable measurements with Spark DataFrames."""

__version__ = "0.1.0"
