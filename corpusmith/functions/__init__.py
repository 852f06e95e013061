"""Column builders: everything here is a Spark expression and stays in the JVM."""
