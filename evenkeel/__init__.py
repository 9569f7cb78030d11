"""Group-fairness and survey analytics on Spark, and operators of a training-data pipeline."""
