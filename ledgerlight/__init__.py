"""ledgerlight: company filings and market prices as composable Spark DataFrame operators."""
