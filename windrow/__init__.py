"""windrow: a library of Spark DataFrame operators for environmental time series."""
