"""From steps to a Spark plan."""
