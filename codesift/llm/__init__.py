"""Operators of a training-data pipeline over the tables documents, embeddings and labels."""
