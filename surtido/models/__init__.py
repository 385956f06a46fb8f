"""Regressors and their stored artifacts."""
