"""Operators for preparing training data from texts and labels."""
