"""Trade and supply-network analytics as PySpark DataFrame operators."""
