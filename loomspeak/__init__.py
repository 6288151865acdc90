"""Spark-native analytics for interview transcripts and the text tables around them."""
