"""Set-at-a-time news analytics on Spark: similarity, summaries, result tables."""
