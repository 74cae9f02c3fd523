"""factloom: Spark-first analytics for evidence-grounded claim verification data."""
