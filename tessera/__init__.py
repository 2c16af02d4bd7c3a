"""tessera: quantity takeoff and estimating for surface coverings, on Spark."""
