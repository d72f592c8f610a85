"""A Spark-native statistical modelling and analytics engine."""
