"""tallyloom: evidence analytics as Spark plans.

Core operators live in ``operators``, column functions in ``functions``,
readers and writers in ``sources``, whole queries in ``plans``, and the
streaming forms in ``streaming``. ``llm`` holds the training-data operators;
nothing outside it imports it.
"""

__version__ = "0.1.0"
