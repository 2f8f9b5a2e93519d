"""Graph analytics over Spark DataFrames: edge lists in, labels, distances and metrics out."""
