"""Column functions; all of them stay in the JVM."""
