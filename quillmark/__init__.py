"""quillmark: code and text quality analytics as declarative Spark plans."""

__version__ = "0.1.0"
