"""Column expressions, fixed values and the step functions of recurrences."""
