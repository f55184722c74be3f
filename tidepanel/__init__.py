"""Cross-sectional time-series panels as Spark DataFrames."""
