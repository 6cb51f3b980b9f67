"""Analytics over source code, SQL and text, built on DataFrames."""
