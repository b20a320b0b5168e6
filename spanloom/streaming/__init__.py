"""Tables that grow by files."""
