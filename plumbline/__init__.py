"""plumbline: DataFrame operators and ready-made queries for purchasing and inventory data."""
