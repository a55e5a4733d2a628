"""Column expressions and driver-side rules."""
