"""sparkloom: a PySpark-native analytics engine for multi-source workspace data."""
