"""tidewire: a Spark-native engine for news-style message streams."""
