"""End-to-end chains and the query catalogue (with SQL oracle texts)."""
