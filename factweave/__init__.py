"""factweave: text to structured, linked statements as lazy Spark DataFrame operators."""

__version__ = "0.1.0"
