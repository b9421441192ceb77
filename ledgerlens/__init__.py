"""ledgerlens: evidence, ledger and text analytics expressed as Spark plans."""
