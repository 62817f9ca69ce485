"""Analytics on manufacturing traceability data, as DataFrame and SQL plans on Spark."""
