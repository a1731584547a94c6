"""Operators over trades, bars, labels, features, predictions and star-schema tables."""
