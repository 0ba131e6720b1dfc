"""siftworks: Spark-native analytics over records, samples, signals and text corpora."""
