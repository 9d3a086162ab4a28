"""Spark-native market-calibration engine."""
