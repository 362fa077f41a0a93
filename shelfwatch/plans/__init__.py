"""The registered queries, the views they read and the SQL that DuckDB can run for them."""
