"""Stages over tables of documents: DataFrame in, DataFrame out."""
