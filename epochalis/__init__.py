"""Spark-native analytics for multichannel time series: epochs, atoms, features, validation."""
