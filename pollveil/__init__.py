"""pollveil: privacy-preserving release and analysis of per-ballot vote records on Spark."""
