"""tidemark: a PySpark-native market-microstructure and liquidity analytics engine."""
