"""Claims analytics on Spark: rule-based adjudication of itemised charges, in bulk on DataFrames."""
