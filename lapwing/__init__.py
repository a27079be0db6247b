"""lapwing: racing analytics and forecasting as Spark jobs."""
