"""lattica: a Spark-native engine for incidence matrices, similarity graphs and label maps."""
