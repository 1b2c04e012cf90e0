"""DataFrame operators over token rows: statistics, prediction, guards, evaluation, retrieval."""
