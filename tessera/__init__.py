"""A SQL analytics engine on Spark."""
