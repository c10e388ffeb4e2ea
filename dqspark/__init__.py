"""Data quality on Spark: profiles, cleaning plans, chart tables and their verification."""
