from ledgerlens.sources.tables import distinct_transactions, table, valid_date

__all__ = ["distinct_transactions", "table", "valid_date"]
