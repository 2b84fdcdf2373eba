"""The registered queries: panel operators over the driver's parquet tables."""
