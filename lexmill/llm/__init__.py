"""Training-data operators: ten self-contained stages over document, page, vector and dialogue tables.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when it is present.
"""
