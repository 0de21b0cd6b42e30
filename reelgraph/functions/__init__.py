"""Column-to-Column functions; none of them leaves the JVM unless its docstring says so."""
