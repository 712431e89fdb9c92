"""Column helpers; all of them are built-in Spark expressions."""
