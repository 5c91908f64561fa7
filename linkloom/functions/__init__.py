"""Column expressions. Everything here is built-in Spark functions; no UDFs."""
