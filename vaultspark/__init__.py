"""PySpark-native analytics and search over note vaults and document tables."""
