"""Column builders: every function here returns a Column and runs inside the JVM's generated code."""
