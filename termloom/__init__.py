"""Panel analytics and cascaded risk scoring on Spark DataFrames."""
