"""Link analytics on Spark: count matrices, interval joins, pair statistics, nulls and evaluation as DataFrame operators."""
