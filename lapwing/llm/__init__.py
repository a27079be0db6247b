"""Operators of a training-data pipeline: one module for each, and a module of registered queries."""
