"""Market and event time-series analytics as DataFrame-to-DataFrame operators on Spark."""
