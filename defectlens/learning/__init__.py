"""Distributed model training and scoring on MLlib."""
