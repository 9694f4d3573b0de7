"""Analytics over versioned property graphs, written as Spark DataFrame plans."""
