"""A Spark-native engine for datasets of long signals: fragments, features, index, splits, augmentations."""
