"""vaultlens: a PySpark-native analytics engine for Markdown knowledge bases."""
