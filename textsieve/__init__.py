"""Build, profile, score and evaluate text corpora for binary classification on Spark."""
