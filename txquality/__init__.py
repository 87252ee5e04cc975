"""Quality, versioning, evaluation and drift jobs for labelled card transactions, written for Spark DataFrames."""
