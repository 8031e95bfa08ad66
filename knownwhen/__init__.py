"""knownwhen: point-in-time market research tables as PySpark DataFrame operators."""
