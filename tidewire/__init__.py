"""tidewire: a PySpark-native engine for news text, annotations, topics and classifiers.

Everything takes DataFrames and gives DataFrames; nothing here starts a session on its own.
"""

__version__ = "0.1.0"
