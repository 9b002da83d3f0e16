"""Column -> Column expressions. Nothing here runs Python on executors."""
