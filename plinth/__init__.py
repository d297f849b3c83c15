"""A Spark-native engine for graph and dataflow questions over plain node and edge tables."""
