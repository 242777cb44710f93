"""Column expressions and window helpers shared by the operators."""
