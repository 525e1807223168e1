"""Storm-track and gridded-weather analytics as PySpark DataFrame operators."""
