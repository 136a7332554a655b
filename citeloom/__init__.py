"""citeloom: bibliographic corpora and co-occurrence networks as Spark plans."""

__version__ = "0.1.0"
