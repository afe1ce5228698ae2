"""leafmill: a Spark-native engine for page-oriented technical documents."""
