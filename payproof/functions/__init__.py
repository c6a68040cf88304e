"""Column functions: every one is a plain Spark expression that stays in the JVM."""
