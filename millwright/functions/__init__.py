"""Column builders; everything here stays inside the JVM."""
