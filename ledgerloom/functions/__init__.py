"""functions of the evidence-ledger engine."""
