"""Column functions: geometry, references and time codes.  All JVM-side."""
