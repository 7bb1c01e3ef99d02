"""A Spark-native engine for running and analysing retrieval-augmented step graders."""
