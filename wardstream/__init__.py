"""Analytics over ordered text observations, as Spark plans."""
