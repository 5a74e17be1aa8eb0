"""A Spark-native engine that turns dictionary-wiki dumps into morpheme segmentations."""
