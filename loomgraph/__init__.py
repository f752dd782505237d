"""Property-graph and vector analytics declared as Spark DataFrame plans."""
