"""coppice: idiom mining over labelled trees, expressed as Spark plans."""

__version__ = "0.1.0"
