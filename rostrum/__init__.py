"""Spark-native analytics over dated, attributed documents with topic weights."""

from rostrum.schema import SPEECH_SCHEMA, TOPIC_COLUMNS, topic_columns

__all__ = ["SPEECH_SCHEMA", "TOPIC_COLUMNS", "topic_columns", "Corpus"]


def __getattr__(name: str):
    if name == "Corpus":
        from rostrum.corpus import Corpus

        return Corpus
    raise AttributeError(name)
