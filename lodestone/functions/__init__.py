"""Column builders: rates, text rules, geometry and set similarity."""
