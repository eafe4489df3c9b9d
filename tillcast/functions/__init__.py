"""Column helpers and skew-aware joins shared by the operators."""
