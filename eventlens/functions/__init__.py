"""Column helpers shared by every operator (all JVM-side, no Python UDF)."""
