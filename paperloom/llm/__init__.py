"""Training-data operators: each module is one operator with a general interface.

``registry`` holds the queries of the engine's entry point.  Nothing outside this
subpackage imports it.
"""
