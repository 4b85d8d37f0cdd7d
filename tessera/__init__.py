"""tessera: a Spark-native engine that turns long documents into searchable, scored chunks."""
