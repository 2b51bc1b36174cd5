"""prowave: graph feature propagation and node-representation learning on Spark."""
