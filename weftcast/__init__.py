"""Panel forecasting on Spark, and training-data operators in ``llm``."""
