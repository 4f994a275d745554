"""Operators for large-scale training-data preparation (nothing else imports this)."""
