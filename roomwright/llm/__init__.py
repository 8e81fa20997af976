"""Operators of a training-data pipeline over tables of texts, vectors, pages and conversations."""
