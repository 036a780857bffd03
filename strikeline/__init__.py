"""Spark-native analytics for minute bars, option chains and daily market series."""
