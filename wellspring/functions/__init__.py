"""Column expressions and small numerics shared by the operators."""
