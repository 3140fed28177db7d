"""Graph, sequence and corpus analytics as Spark DataFrame plans."""
