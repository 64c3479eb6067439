"""jetframe: Spark operators for labelled records that own variable-length child arrays."""

__version__ = "0.1.0"
