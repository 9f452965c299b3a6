"""strophe: a PySpark-native engine for preparing song-lyric data.

Every operator takes and returns DataFrames; `strophe.llm` holds the
training-data operators and is imported by nothing else in the package.
"""

__version__ = "0.1.0"
