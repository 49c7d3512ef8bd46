"""boughline: a Spark-native engine for content-addressed tree manifests."""

__version__ = "0.1.0"
