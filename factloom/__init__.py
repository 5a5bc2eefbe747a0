"""factloom: bi-temporal fact analytics as plain Spark DataFrame plans."""
