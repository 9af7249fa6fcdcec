"""Column helpers shared by all operators (JVM-side expressions, no Python UDFs)."""
