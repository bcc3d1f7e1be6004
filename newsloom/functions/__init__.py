"""Column-to-column functions that stay inside the JVM."""
