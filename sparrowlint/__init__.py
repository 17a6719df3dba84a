"""Static analysis of SQL, and of the code that builds it, as Spark dataflows."""
