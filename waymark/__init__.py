"""Analytics over trail networks and walks, expressed as Spark DataFrame operators."""
