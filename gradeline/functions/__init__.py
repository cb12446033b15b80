"""Column expressions; all of them are built-in functions and stay inside code generation where Spark allows it."""
