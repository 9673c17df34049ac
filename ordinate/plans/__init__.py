"""How stored state becomes a Spark plan."""
