"""Column formulas and numpy kernels."""
