"""Column helpers: text, numbers and dates. Everything here stays inside the JVM."""
