"""Spark-native analytics over capture graphs: frame streams, match graphs, trajectories and tracks."""
