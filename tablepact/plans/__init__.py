"""End to end: running a contract and checking it before a release."""
