"""Column-expression building blocks shared by all operators (JVM-side, codegen friendly)."""
