"""Column expressions. Everything here is a native expression: no Python runs per row."""
