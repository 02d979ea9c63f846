"""Evidence ledger, disclosure text, capacity and forecast analytics as Spark DataFrame operators."""
