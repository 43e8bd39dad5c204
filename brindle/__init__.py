"""brindle: a PySpark-native engine for scoped queries, metering, ledgers, trees, event logs and documents."""
