"""Account-retention analytics as Spark DataFrame operators."""
