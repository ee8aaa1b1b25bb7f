"""Job-market skill-demand analytics as Spark DataFrame operators."""
