"""Readers and writers of sentences, predictions, dictionaries and correction logs."""
