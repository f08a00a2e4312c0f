"""Poolscope: liquidity-pool event analytics expressed as PySpark DataFrame plans."""
