"""Record linkage and training-data preparation as lazy Spark plans."""
