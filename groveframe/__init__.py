"""groveframe: a Spark-native engine for forest point clouds."""
