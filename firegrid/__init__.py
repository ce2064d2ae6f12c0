"""firegrid: satellite thermal-anomaly analytics on Spark."""
