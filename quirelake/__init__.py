"""quirelake: a PySpark engine for structured-document corpora and their translation memory."""

__version__ = "0.1.0"
