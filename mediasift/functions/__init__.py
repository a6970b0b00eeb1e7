"""Column functions: everything here maps columns to columns inside the JVM."""
