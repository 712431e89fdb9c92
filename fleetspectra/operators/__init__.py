"""DataFrame -> DataFrame operators. All are lazy and take columns by name."""
