"""Column-in / Column-out functions; everything here stays in the JVM unless a docstring says otherwise."""
