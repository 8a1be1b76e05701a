"""Column expressions: curves, tone, colour, quaternions, geometry, text and binary fields."""
