"""eventide: event-skill analytics and corpus preparation as Spark DataFrame operators."""
