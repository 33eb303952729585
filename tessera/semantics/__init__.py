"""What the dialect means where Spark means something else, as Spark SQL expressions."""
