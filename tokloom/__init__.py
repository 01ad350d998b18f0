"""tokloom: exact byte-level BPE tokenization as Spark DataFrame operators."""

__version__ = "0.1.0"
