"""Build, prepare, score and analyse multi-label text datasets with Spark DataFrames."""
