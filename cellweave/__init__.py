"""Spark-native detection, segmentation, linking and statistics of objects in gridded fields."""
