"""Training-data operators over ``documents``, ``pages`` and ``conversations``.

One module per operator; ``queries.py`` registers them with their production
parameters.  Nothing outside this subpackage imports it.
"""
