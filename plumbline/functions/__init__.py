"""Column expressions shared by every operator (all JVM-side built-ins)."""
