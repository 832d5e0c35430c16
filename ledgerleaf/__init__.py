"""ledgerleaf: business documents in, reviewed and measured tables out, on PySpark."""
