"""operators of the evidence-ledger engine."""
