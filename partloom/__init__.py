"""partloom: bill-of-material standardisation, classification and revenue analytics on Spark."""
