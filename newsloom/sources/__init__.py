"""Scans and the batch-directory table."""
