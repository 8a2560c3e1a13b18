"""Daily-panel forecasting analytics as Spark jobs."""
