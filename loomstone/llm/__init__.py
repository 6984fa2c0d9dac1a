"""Training-data operators: one module per operator, queries registered in ``queries``.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only when it is present.
"""
