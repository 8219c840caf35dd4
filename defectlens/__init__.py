"""Spark-native analytics for predicting defects in generated code."""
