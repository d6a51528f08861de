"""Training-data pipeline operators.

Self-contained: nothing outside this folder imports it.
"""
